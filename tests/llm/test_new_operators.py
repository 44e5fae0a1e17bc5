"""Spelling variants, centroid clustering and licence scans against brute force, and their defined results on odd input."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallycast.llm import centroids, common, license_scan, spelling
from tests.llm.test_operators import documents, odd_texts

# --- spelling variants ------------------------------------------------------------------------


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {word: n for word, n in counts.items() if len(word) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(rows):
    words = plain_words(rows)
    gone = {}
    for word in words:  # words that share one, or are one, with a code point deleted may be near
        for key in {word} | {word[:i] + word[i + 1:] for i in range(len(word))}:
            gone.setdefault(key, set()).add(word)
    near = {word: set() for word in words}
    for group in gone.values():
        for a, b in itertools.combinations(group, 2):
            if one_apart(a, b):
                near[a].add(b)
                near[b].add(a)
    forms = {}
    for word, n in words.items():
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        forms[word] = best if best is not None and words[best] >= 2 * n else None
    found = set()
    for word, n in words.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        found.add((word, forms[word], root, n, len(near[word]), words.get(forms[word])))
    return found


def spelled_out(docs, **options):
    rows = spelling.variants(docs, **options).collect()
    found = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(found) == len(rows)
    return found


def test_spelling_of_a_whole_table(spark, folder):
    docs = common.table(spark, folder, "documents")
    assert spelled_out(docs) == plain_variants([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("block_words", [4, 8192])
def test_spelling_of_dense_words_in_blocks(spark, block_words):
    rng, rows = random.Random(3), odd_texts()
    for i in range(300):  # few letters and one beginning: many words one edit apart, in one partition
        rows.append((i, " ".join("aa" + "".join(rng.choices("abé", k=rng.randrange(2, 8))) for _ in range(40))))
    rows += [(i, f"{'q' * 3000}z {'q' * 3000} Long{'q' * 500} long{'q' * 501}") for i in range(4)]
    expected = plain_variants(rows)
    assert len(expected) > 500 and any(e[2] not in (e[0], e[1]) for e in expected)
    assert spelled_out(documents(spark, rows), block_words=block_words) == expected


def test_spelling_of_empty_tables(spark):
    assert spelled_out(documents(spark, [(1, None)])) == set()
    assert spelled_out(documents(spark, [(1, None)]).limit(0)) == set()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abc", max_size=5), max_size=40))
def test_composition_yields_each_near_pair_once(words):
    words = sorted(words)
    found = [tuple(sorted(pair)) for pair in spelling.one_edit_pairs(spelling.Acceptor(words))]
    assert sorted(found) == [(i, j) for i, j in itertools.combinations(range(len(words)), 2) if one_apart(words[i], words[j])]


def test_acceptors_are_minimal():
    machine = spelling.Acceptor(sorted("".join(letters) for letters in itertools.product("ab", repeat=6)))
    assert len(machine.edges) == 7 and machine.words_of[machine.start] == 64


# --- centroid clustering ----------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(
        [(*row, None, "own") for row in rows], "vec_id long, embedding array<float>, label int, cluster string").withColumn("vec", F.lit(0))


def plain_nearest(points, middles):
    apart = ((points[:, None, :] - middles[None]) ** 2).sum(axis=2)
    return apart.argmin(axis=1), apart.min(axis=1)


@pytest.mark.parametrize("kind", ["spread", "ties", "equal"])
def test_tree_finds_the_nearest_with_the_smaller_number(kind):
    rng = np.random.default_rng(1)
    points = {"spread": rng.integers(-300, 300, (500, 4)), "ties": rng.integers(0, 3, (500, 4)), "equal": np.ones((500, 4), np.int64)}[kind]
    middles = points[rng.integers(0, 500, 40)]
    number, best, measured = centroids.Tree(middles).nearest(points)
    plain_number, plain_best = plain_nearest(points, middles)
    assert (number == plain_number).all() and (best == plain_best).all()
    assert kind != "spread" or measured < 500 * 40 * 0.7  # branches are pruned


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(2)
    good = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.3]) for _ in range(3)]) for i in range(60)]
    good += [(7, [0.1, 0.1, 0.1]), (7, [0.1, 0.1, 0.1]), (None, [-0.001, 0.0, 0.0])]
    bad = [(100, None), (101, [1.0, 2.0]), (102, [1.0, None, 2.0]), (103, [float("nan"), 1.0, 1.0]), (104, [float("inf"), 1.0, 1.0])]
    assigned, middles = centroids.cluster(vectors(spark, good + bad), count=9, rounds=3, dimensions=3)
    rows = centroids.digest(assigned, middles).collect()
    assert Counter(r.vec_id for r in rows) == Counter(i for i, _ in good)
    points = np.array([[int(np.floor(256 * float(np.float32(x)))) for x in vec] for _, vec in good])
    assert (middles == plain_clusters(good, points, 9, 3)).all()
    number, best = plain_nearest(points, middles)
    assert Counter((r.vec_id, r.cluster, r.distance) for r in rows) == Counter(
        (i, int(n), int(d)) for (i, _), n, d in zip(good, number, best))
    assert {r.inertia for r in rows} == {int(best.sum())}
    assert all(r.cluster_inertia == int(best[number == r.cluster].sum()) for r in rows)


def plain_clusters(rows, points, count, rounds):
    import hashlib

    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), tuple(p)) for (i, _), p in zip(rows, points.tolist()) if i is not None)
    middles = np.array([p for _, p in order[:count]])
    for _ in range(rounds):
        number, _ = plain_nearest(points, middles)
        for c in set(number.tolist()):
            middles[c] = points[number == c].sum(axis=0) // (number == c).sum()
    return middles


def test_clusters_of_few_and_no_vectors(spark):
    few = [(1, [0.5, 0.5]), (2, [0.25, 0.0])]
    assigned, middles = centroids.cluster(vectors(spark, few), dimensions=2)
    assert len(middles) == 2 and {r.distance for r in assigned.collect()} == {0}
    for rows in ([(1, None)], [(None, [1.0, 1.0])]):
        assert centroids.digest(*centroids.cluster(vectors(spark, rows), dimensions=2)).count() == 0
    with pytest.raises(Exception, match="beyond the range"):
        centroids.cluster(vectors(spark, [(1, [1e30, 0.0])]), dimensions=2)


# --- licences ---------------------------------------------------------------------------------

BODIES = [(rule, rule.pattern.pattern.decode().removeprefix("(?<= )(?:").removesuffix(")(?= )")) for rule in license_scan.rules()]


def plain_licenses(text):
    """All rules on every text, every pair of detections compared."""
    words = [w for w in re.split("[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or "")) if w]
    joined, found = f" {' '.join(words)} ", []
    for number, (rule, body) in enumerate(BODIES):
        for m in re.finditer(f"(?<= )(?:{body})(?= )", joined):
            start = joined[:m.start()].count(" ") - 1
            found.append((rule.priority, start, start + m.group().count(" ") + 1, number, rule.label))
    kept = []
    for d in sorted(found, key=lambda d: (d[0], d[1], -d[2], d[3])):
        if d[0] == 0 or not any(k[0] and k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    base = [d for d in kept if d[0] == 0]
    return (len(words), len(base), min((d[1] for d in base), default=None), max((d[1] for d in base), default=None),
            ",".join(sorted({d[4] for d in base})), ",".join(sorted({d[4] for d in kept})),
            max((license_scan.STRENGTHS[d[0]] for d in kept), default=0.0),
            ",".join(f"{d[4]}:{d[1]}:{d[2]}" for d in sorted(kept, key=lambda d: (d[1], d[2], d[3]))))


def test_there_are_hundreds_of_rules_and_their_keywords_are_in_every_match():
    assert len(BODIES) > 200
    for rule, body in BODIES:
        @settings(max_examples=6, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(body, re.ASCII), fullmatch=True))
        def holds(text):
            assert {word.decode() for word in rule.keywords} <= set(text.split())
        holds()


def license_texts():
    rng, texts = random.Random(4), []
    samples = []
    for _, body in BODIES:
        plain = re.sub(r"\.\{1,200\}\?", "the owner", body).replace(r"\w+", "un").replace(r"\d", "4")
        for keep in (True, False):
            text = plain
            while "(" in text:  # innermost groups first: an optional one is kept or goes, of alternatives one stays
                text = re.sub(r"\(\?:([^()]*)\)(\??)", lambda m: "" if m[2] and not keep else rng.choice(m[1].split("|")), text)
            samples.append(re.sub(r"\[sc\]", lambda _: rng.choice("sc"), re.sub(r"(\w| )\?", lambda m: m[1] if keep else "", text)))
    for i in range(400):
        pieces = rng.choices(samples, k=rng.randrange(1, 6))
        text = rng.choice([" ", ", ", ".\n", "-"]).join(p.title() if rng.random() < 0.3 else p for p in pieces)
        texts.append((i, text + rng.choice(["", " für naïve 日本 mit", " v2.0; CC-BY-NC"])))
    return texts


def test_licenses_of_whole_and_odd_tables(spark, folder):
    table = common.table(spark, folder, "documents").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in table] + license_texts() + odd_texts()
    rows += [(900_000, "under the MIT license, GPLv3 / " * 3000), (900_001, "cc by nc nd 4.0\x00cc by nc")]
    found = [tuple(r) for r in license_scan.scan(documents(spark, rows)).collect()]
    expected = [(i, *plain_licenses(text)) for i, text in rows if i != 900_000]
    assert Counter(f for f in found if f[0] != 900_000) == Counter(expected)
    long = next(f for f in found if f[0] == 900_000)
    assert long[1:7] == (15000, 3000, 0, 14995, "mit", "gpl-3,mit")
    assert sum("," in e[6] for e in expected) > 100
    assert license_scan.scan(documents(spark, [(1, "")]).limit(0)).count() == 0


# --- pipeline stages --------------------------------------------------------------------------


def test_pages_of_one_template_send_no_shingles(spark):
    from tallycast.llm import near_copies

    rng = random.Random(8)
    shared = [f"t{i}" for i in range(62)]
    texts = [" ".join(shared + [f"w{rng.randrange(10**6)}" for _ in range(40)]) for _ in range(300)]
    hashes = [near_copies.shingles(text.encode()) for text in texts]
    keys, sketches = zip(*(near_copies.band_keys(h) for h in hashes))
    keys, sizes = np.array(keys), np.array([len(h) for h in hashes])
    sketches = np.array([np.frombuffer(s, np.uint8) for s in sketches])
    blocks = np.zeros((300, 3), int)
    assert any((keys[a] == keys[b]).any() for a, b in itertools.combinations(range(300), 2))
    assert not list(near_copies.possible_pairs(keys, sketches, sizes, 0, blocks))
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    assert all(r.group == r._row for r in near_copies.groups(rows).collect())


def test_stages_return_columns_of_any_name_as_they_came(spark, folder):
    import corpus_pipeline

    docs = common.table(spark, folder, "documents").withColumns({
        "_row": F.lit("mine"), "`a.b`": F.col("doc_id") * 2, "_score": F.lit(1), "_doc": F.lit("d"), "text2": F.col("text"), "group": F.lit(None).cast("int"),
        "v": F.lit(7), "_quality_score": F.lit("q")})
    docs = docs.withColumnRenamed("`a.b`", "a.b") if "`a.b`" in docs.columns else docs
    extra = [name for name in docs.columns if name not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert "a.b" in extra
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, common.keep(stage(spark, docs, folder))
        assert docs.columns == before.columns, name
        picked = ["doc_id", *[f"`{c}`" for c in extra]]
        assert set(docs.select(*picked).collect()) <= set(before.select(*picked).collect()), name
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() > 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_any_tokenizer_file(name):
    from tokenizers import Tokenizer

    from tallycast.llm.queries import tokenizer_path
    from tallycast.llm.tokens import Encoder

    path = tokenizer_path().replace("word_bpe_49k.json", name)
    plain = Tokenizer.from_file(path)
    found = Encoder(path)
    assert found.cuts == (name == "word_bpe_49k.json")
    texts = ["", " ", "Plain Words, and  two blanks\nline 42.", "it's <|endoftext|> ok", "naïve Ünïcode 日本語 \t tab", "x" * 3000, "A b " * 400]
    for text, ids in zip(texts, found.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_vector_too_long_for_a_code_is_an_error(spark):
    from tallycast.llm.hamming_search import sign_code

    rows = spark.createDataFrame([(1, [1.0, -1.0, 2.0]), (2, None), (3, [-1.0] * 63 + [1.0])], "vec_id long, v array<float>")
    found = rows.select("vec_id", sign_code(F.col("v")).alias("c")).orderBy("vec_id").collect()
    assert [r["c"] for r in found] == [5, None, -(1 << 63)]
    with pytest.raises(Exception, match="more components"):
        spark.createDataFrame([(4, [1.0] * 65)], "vec_id long, v array<float>").select(sign_code(F.col("v"))).collect()


def test_near_copies_also_come_from_near_fingerprints(spark, monkeypatch):
    from tallycast.llm import near_copies, simhash

    monkeypatch.setattr(near_copies, "_active", lambda batches: iter(()))  # no pair by bands
    words = [f"w{i * i % 997}x{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "other"]), " ".join(f"u{i * 7 % 401}" for i in range(300)), "one two three", "", None]
    prints = [simhash.fingerprint(t.encode()) for t in texts[:2]]
    assert bin((prints[0] ^ prints[1]) & (1 << 64) - 1).count("1") <= simhash.MAX_BITS and texts[0] != texts[1]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    assert {r._row: r.group for r in near_copies.groups(rows).collect()} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4}


def test_near_fingerprints_of_dissimilar_texts_stay_apart(spark):
    from tallycast.llm import near_copies, simhash

    texts = ["a b c d a b c d a b", "a b c d a b c d a z"]  # sets of five-word shingles differ, most four-word shingles repeat
    one, two = (simhash.fingerprint(t.encode()) for t in texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    found = {r._row: r.group for r in near_copies.groups(rows).collect()}
    sets = [near_copies.shingles(t.encode()) for t in texts]
    assert (found[0] == found[1]) == near_copies.similar(*sets) and isinstance(one ^ two, int)


def test_exploded_lists_are_not_broadcast(spark):
    """Spark takes the lists of a fingerprint for as many rows as there are fingerprints, and would broadcast them all."""
    from tallycast.llm import simhash

    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    plan = simhash.links(spark.range(1000).selectExpr("id * 7919 as fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_texts_of_a_fingerprint_class_are_compared_all_with_all(spark, monkeypatch):
    """Two similar texts are linked by their class also where neither is similar to the class's first one, or the class holds another of their rows."""
    from tallycast.llm import near_copies, simhash

    monkeypatch.setattr(near_copies, "_active", lambda batches: iter(()))  # no pair by bands
    words = [f"w{i}" for i in range(200)]
    twin, far, alone = " ".join(words), " ".join(f"u{i}" for i in range(230)), " ".join(f"z{i}" for i in range(50))
    texts = [far, twin, " ".join([*words[:199], "other"]), alone, twin, alone.upper()]
    for classes in ([0, 0, 0, 3, 0, 3], [0, 1, 2, 3, 2, 3]):  # one class with a first text unlike the others; a class by the second row of a text
        found = spark.createDataFrame(list(enumerate(classes)), "doc_id long, component_id long")
        monkeypatch.setattr(simhash, "near_duplicates", lambda docs, found=found: found)
        rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
        assert {r._row: r.group for r in near_copies.groups(rows).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 1, 5: 3}


def test_near_copies_broadcast_no_exploded_keys(spark, monkeypatch):
    from tallycast.llm import common, near_copies

    plans, map_batches = [], common.map_batches

    def planned(df, work, schema):
        if "_band" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return map_batches(df, work, schema)

    monkeypatch.setattr(common, "map_batches", planned)
    near_copies.groups(spark.createDataFrame([(i, f"one two three four five six {i % 3}") for i in range(30)], "_row long, text string"))
    assert len(plans) == 3 and not any("BroadcastHashJoin" in plan for plan in plans)
