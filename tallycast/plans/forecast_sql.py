"""SQL for the series and the models: array folds that repeat what the fits compute.

Each model part expects a CTE ``packed(sku, n, last_period, ys)`` and adds CTEs named after
the model: (sku, forecast, lower, upper, mape, mae, rmse).
"""

from __future__ import annotations

from itertools import product

from tallycast.config import GRID

NUMBER = "CAST({} AS DOUBLE)"
BUCKET = {
    "D": "date",
    "W": "CAST(date_trunc('week', date) AS DATE) + 6",
    "M": "last_day(date)",
}
LABELS = {
    "D": "CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 DAY)) AS DATE)",
    "W": "CAST(unnest(generate_series(min(period), max(period), INTERVAL 7 DAY)) AS DATE)",
    "M": "last_day(CAST(unnest(generate_series(date_trunc('month', min(period)), date_trunc('month', max(period)), INTERVAL 1 MONTH)) AS DATE))",
}
AHEAD = {
    "D": "last_period + CAST({step} AS INT)",
    "W": "last_period + CAST(7 * {step} AS INT)",
    "M": "last_day(CAST(date_trunc('month', last_period) + to_months(CAST({step} AS INT)) AS DATE))",
}


def series_sql(freq: str) -> str:
    return f"""totals AS (SELECT sku, {BUCKET[freq]} AS period, sum(quantity) AS y FROM demand GROUP BY ALL),
    calendar AS (SELECT sku, {LABELS[freq]} AS period FROM totals GROUP BY sku),
    series AS (SELECT sku, period, coalesce(y, CAST(0 AS DOUBLE)) AS y FROM calendar LEFT JOIN totals USING (sku, period)),
    packed AS (SELECT sku, count(*) AS n, max(period) AS last_period, list(y ORDER BY period) AS ys FROM series GROUP BY sku)"""


def _grid(name: str, columns: str, rows) -> str:
    values = ", ".join("(" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in row) + f", {i})" for i, row in enumerate(rows))
    return f"{name}({columns}, i) AS (VALUES {values})"


def _measures(errors: str, actual: str) -> str:
    """mape, mae, rmse from lists of errors and actual values."""
    return f"""coalesce(list_avg(list_transform(list_filter(list_zip({errors}, {actual}), lambda p: p[2] <> 0), lambda p: abs(p[1] / p[2]))), 0) * 100 AS mape,
        list_avg(list_transform({errors}, lambda e: abs(e))) AS mae, sqrt(list_avg(list_transform({errors}, lambda e: e * e))) AS rmse"""


def _banded(forecast: str, sd: str) -> str:
    return f"""list_transform({forecast}, lambda f: greatest(0, f)) AS forecast,
        list_transform({forecast}, lambda f: greatest(0, greatest(0, f) - 1.96 * {sd})) AS lower,
        list_transform({forecast}, lambda f: greatest(0, f) + 1.96 * {sd}) AS upper"""


def naive_sql(h: int) -> str:
    return f"""naive AS (SELECT sku, list_transform(range(1, {h + 1}), lambda i: ys[n]) AS forecast,
        list_transform(range(1, {h + 1}), lambda i: greatest(0, ys[n] - 1.96 * sd)) AS lower, list_transform(range(1, {h + 1}), lambda i: ys[n] + 1.96 * sd) AS upper,
        {_measures('list_transform(ys, lambda y: y - m)', 'ys')} FROM (
        SELECT *, list_avg(ys) AS m, coalesce(list_stddev_samp(ys), ys[n] * 0.1) AS sd FROM packed))"""


def seasonal_naive_sql(m: int, h: int) -> str:
    fit = f"list_transform(ys, lambda y, i: y - CASE WHEN i > {m} THEN ys[i - {m}] ELSE mean END)"
    return f"""snaive_base AS (SELECT *, list_avg(ys) AS mean, list_stddev_samp(ys) AS dev FROM packed),
    snaive_f AS (SELECT *, list_transform(range(1, {h + 1}), lambda i: CASE WHEN n >= {m} - (i - 1) % {m} THEN ys[n - {m} + (i - 1) % {m} + 1] ELSE mean END) AS f FROM snaive_base),
    seasonal_naive AS (SELECT sku, f AS forecast, list_transform(f, lambda v: greatest(0, v - 1.96 * coalesce(dev, list_avg(f) * 0.1))) AS lower,
        list_transform(f, lambda v: v + 1.96 * coalesce(dev, list_avg(f) * 0.1)) AS upper, {_measures(fit, 'ys')} FROM snaive_f)"""


def smoothing_sql(m: int, h: int, name: str = "exponential_smoothing", where: str = "n >= 2") -> str:
    """m = 1: no season."""
    points = product(GRID.alphas, GRID.betas, GRID.gammas if m > 1 else (0.0,))
    e = "(y - s.l - s.b - s.s[1])"
    state = f"'l': s.l + s.b + a * {e}, 'b': s.b + a * b * {e}, 's': list_append(s.s[2:], s.s[1] + g * {e})"
    if m > 1:
        start = f"'l': level, 'b': CAST(0 AS DOUBLE), 's': list_transform(ys[1:{m}], lambda y: y - level)"
    else:
        start = "'l': level, 'b': CAST(0 AS DOUBLE), 's': [CAST(0 AS DOUBLE)]"
    return f"""{name}_base AS (SELECT *, list_avg(ys[1:{m}]) AS level, ys[{m + 1}:] AS tail FROM packed WHERE {where}),
    {_grid(name + '_grid', 'a, b, g', points)},
    {name}_runs AS (SELECT t.*, p.*, list_reduce(tail, lambda s, y: {{{state}, 'e': s.e + {e} * {e}}}, {{{start}, 'e': CAST(0 AS DOUBLE)}}).e AS sse
        FROM {name}_base t, {name}_grid p),
    {name}_best AS (SELECT * FROM {name}_runs QUALIFY row_number() OVER (PARTITION BY sku ORDER BY sse, i) = 1),
    {name}_fit AS (SELECT *, list_reduce(tail, lambda s, y: {{{state}, 'e': list_append(s.e, {e})}}, {{{start}, 'e': CAST([] AS DOUBLE[])}}) AS st FROM {name}_best),
    {name}_f AS (SELECT *, list_transform(range(1, {h + 1}), lambda h: st.l + h * st.b + st.s[(h - 1) % {m} + 1]) AS f, coalesce(list_stddev_samp(st.e), 0) AS dev FROM {name}_fit),
    {name} AS (SELECT sku, {_banded('f', 'dev')}, {_measures('st.e', 'tail')} FROM {name}_f)"""


def arima_sql(h: int) -> str:
    e = "(x.w - phi * s.w - theta * s.e)"
    return f"""arima_base AS (SELECT *, list_transform(range(3, n + 1), lambda k: {{'w': ys[k] - ys[k - 1], 'y': ys[k]}}) AS rest, ys[2] - ys[1] AS w1 FROM packed WHERE n >= 10),
    {_grid('arima_grid', 'phi, theta', product(GRID.phis, GRID.thetas))},
    arima_runs AS (SELECT t.*, p.*, list_reduce(rest, lambda s, x: {{'w': x.w, 'e': {e}, 'q': s.q + {e} * {e}}}, {{'w': w1, 'e': CAST(0 AS DOUBLE), 'q': CAST(0 AS DOUBLE)}}).q AS sse
        FROM arima_base t, arima_grid p),
    arima_best AS (SELECT * FROM arima_runs QUALIFY row_number() OVER (PARTITION BY sku ORDER BY sse, i) = 1),
    arima_fit AS (SELECT *, list_reduce(rest, lambda s, x: {{'w': x.w, 'e': {e}, 'q': list_append(s.q, {e})}}, {{'w': w1, 'e': CAST(0 AS DOUBLE), 'q': CAST([] AS DOUBLE[])}}) AS st FROM arima_best),
    arima_f AS (SELECT *, list_transform(range(1, {h + 1}), lambda h: ys[n] + (phi * st.w + theta * st.e) * (1 - phi ** h) / (1 - phi)) AS f,
        list_transform(range(1, {h + 1}), lambda h: 1.96 * sqrt(sse / (n - 2) * list_sum(list_transform(range(0, h), lambda j: (1 + (phi + theta) * (1 - phi ** j) / (1 - phi)) ** 2)))) AS half FROM arima_fit),
    arima AS (SELECT sku, list_transform(f, lambda v: greatest(0, v)) AS forecast, list_transform(list_zip(f, half), lambda p: greatest(0, p[1] - p[2])) AS lower,
        list_transform(list_zip(f, half), lambda p: p[1] + p[2]) AS upper, {_measures('st.q', 'list_transform(rest, lambda x: x.y)')} FROM arima_f)"""


def likelihood_sql(points) -> str:
    """Exact log likelihood of ARIMA(1,1,1) by its one-step forecasts g and their relative variances r."""
    e = "(x - s.g)"
    return f"""{_grid('points', 'phi, theta', points)},
    filtered AS (SELECT sku, n - 1 AS size, phi, theta, list_reduce(list_transform(range(2, n + 1), lambda k: ys[k] - ys[k - 1]), lambda s, x: {{
            'g': phi * x + theta * {e} / s.r, 'r': 1 + theta * theta * (1 - 1 / s.r), 'q': s.q + {e} * {e} / s.r, 'v': s.v + ln(s.r)}},
        {{'g': CAST(0 AS DOUBLE), 'r': (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi), 'q': CAST(0 AS DOUBLE), 'v': CAST(0 AS DOUBLE)}}) AS st
        FROM packed, points WHERE n >= 3),
    likelihood AS (SELECT sku, phi, theta, CASE WHEN st.q > 0 THEN -(size * (ln(2 * pi() * st.q / size) + 1) + st.v) / 2 END AS loglik FROM filtered)"""


def theta_sql(m: int, h: int) -> str:
    """For series of at least two seasons."""
    slope = "list_sum(list_transform({v}, lambda y, i: (i - 1 - (n - 1) / 2) * y)) / (n * (n * n - 1) / 12)"
    return f"""theta_a AS (SELECT *, {slope.format(v='ys')} AS slope FROM packed WHERE n >= {2 * m}),
    theta_b AS (SELECT *, list_transform(ys, lambda y, i: y - slope * (i - 1)) AS flat FROM theta_a),
    theta_c AS (SELECT *, list_transform(range(0, {m}), lambda k: list_avg(list_filter(flat, lambda v, i: (i - 1) % {m} = k))) AS raw FROM theta_b),
    theta_d AS (SELECT *, list_transform(raw, lambda v: v - list_avg(raw)) AS season FROM theta_c),
    theta_e AS (SELECT *, list_transform(ys, lambda y, i: y - season[(i - 1) % {m} + 1]) AS z FROM theta_d),
    {_grid('theta_grid', 'alpha', [(a,) for a in GRID.theta_alphas])},
    theta_runs AS (SELECT t.*, p.*, {slope.format(v='z')} / 2 AS half, list_reduce(z[2:], lambda s, y: {{'l': s.l + alpha * (y - s.l), 'e': s.e + (y - s.l) * (y - s.l)}},
        {{'l': z[1], 'e': CAST(0 AS DOUBLE)}}).e AS sse FROM theta_e t, theta_grid p),
    theta_best AS (SELECT * FROM theta_runs QUALIFY row_number() OVER (PARTITION BY sku ORDER BY sse, i) = 1),
    theta_fit AS (SELECT *, list_reduce(z[2:], lambda s, y: {{'l': s.l + alpha * (y - s.l), 'q': list_append(s.q, y - s.l)}}, {{'l': z[1], 'q': CAST([] AS DOUBLE[])}}) AS st FROM theta_best),
    theta_g AS (SELECT *, list_transform(st.q, lambda e, t: e - half * (1 - (1 - alpha) ** t) / alpha) AS errors, list_stddev_samp(ys) AS dev,
        list_transform(range(1, {h + 1}), lambda h: st.l + half * (h - 1 + (1 - (1 - alpha) ** n) / alpha) + season[CAST((n + h - 1) % {m} AS INT) + 1]) AS f FROM theta_fit),
    theta AS (SELECT sku, {_banded('f', 'dev')}, {_measures('errors', 'ys[2:]')} FROM theta_g)"""


def nested(name: str, label: str | None = None, rank: int = 0) -> str:
    return f"SELECT sku, '{label or name}' AS model, {rank} AS model_rank, forecast, lower, upper, mape, mae, rmse FROM {name}"


def long_sql(source: str, freq: str) -> str:
    """Rows per step of a nested (sku, model, forecast, lower, upper) table."""
    return f"""SELECT sku, model, step, {AHEAD[freq].format(step='step')} AS date, forecast[step] AS forecast, lower[step] AS lower_bound, upper[step] AS upper_bound
        FROM (SELECT r.*, last_period, unnest(range(1, len(forecast) + 1)) AS step FROM {source} r JOIN packed USING (sku))"""


def ensemble_sql(members) -> str:
    lists = [f"list_zip({', '.join(f'{name}.{part}' for name in members)})" for part in ("forecast", "lower", "upper")]
    k = len(members)
    parts = [
        f"list_transform({zipped}, lambda p: ({' + '.join(f'p[{i + 1}]' for i in range(k))}) / {k}) AS {part}"
        for part, zipped in zip(("forecast", "lower", "upper"), lists)
    ]
    errors = [f"({' + '.join(f'{name}.{part}' for name in members)}) / {k} AS {part}" for part in ("mape", "mae", "rmse")]
    joins = " ".join(f"JOIN {name} USING (sku)" for name in members[1:])
    return f"ensemble AS (SELECT sku, {', '.join(parts + errors)} FROM {members[0]} {joins})"
