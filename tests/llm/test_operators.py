"""The training-data operators against brute force on small tables with every awkward case."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import binary, counts, hashing, mixing, neardup, packing, quality, repeats, sharding, topk, warc
from quillon.llm.common import Workspace
from quillon.llm.components import components as union_of
from quillon.llm.suffixes import common_prefixes, suffix_array
from quillon.llm.tokens import Encoder, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, size long, shard int, word string"


def corpus():
    """Null ids and texts, empty and long texts, copies, near copies, shared passages, a source with a third of the rows, clashing columns."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(90), text(120)
    rows = [(k, text(rng.randint(1, 150)), "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(60)]
    for k in range(60, 80):
        near = base.split()
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((k, " ".join(near), "hot"))
    rows += [(k, f"{text(20)} {passage} {text(15)}", None) for k in range(80, 90)]
    rows += [(k, base, "copy") for k in range(90, 100)] + [(100, text(20_000), "long"), (101, "", "s1"), (102, None, "s1"), (None, "no id here at all", None), (None, None, None), (103, " \n\t ", "s2"), (90, base, "copy"), (104, "x" * 900, "s3"), (105, "A b\tC d", "s1"), (106, "a B c D", "s1")]
    return [(a, b, c, 7, 3, "extra") for a, b, c in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(got, *columns):
    return Counter(tuple(getattr(r, c) for c in columns) for r in got)


def test_mixing(spark, docs, rows, none):
    got = mixing.taken(mixing.plan(spark, docs)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    assert bag(got, "doc_id", "size") == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    total, weight = sum(sizes.values()), {s: (1, 2, 3)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    free, left, target = dict(weight), total, {}
    while over := [s for s in free if weight[s] * left > 3 * sizes[s] * sum(free.values())]:
        target |= {s: 3.0 * sizes[s] for s in over}
        left = total - sum(target.values())
        free = {s: w for s, w in free.items() if s not in target}
    target |= {s: weight[s] * left / sum(free.values()) for s in free}
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(sizes[s], round(target[s], 6)) for s in sizes})
    assert all(r.taken <= 3 * r.size for r in got) and abs(sum(r.taken for r in got) - total) < 0.05 * total
    assert bag(mixing.taken(mixing.plan(spark, docs.repartition(5))).collect(), "doc_id", "taken") == bag(got, "doc_id", "taken")
    assert mixing.taken(mixing.plan(spark, none)).count() == 0
    mixed = mixing.mixed_rows(spark, docs)
    assert mixed.columns == docs.columns and all(r.text in {t for _, t, _ in rows} or any(r.text in (t or "") for _, t, _ in rows) for r in mixed.collect())


def test_small_sources_reach_their_targets(spark):
    data = [(k, "w " * 500, "big") for k in range(400)] + [(1000 + k, "w " * n, f"s{k:02}") for k, n in enumerate((1, 30, 100, 500, 1000, 2000, 3000, 10_000))]
    got = mixing.taken(mixing.plan(spark, spark.createDataFrame(data, "doc_id long, text string, source string"), block_words=4096))
    sums = got.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(sums) == 9
    for r in sums:
        assert abs(r.taken - r.target) <= max(1, min(4096, r.source_size / 16)), r


def test_schedule_ranks_are_gapless(spark, docs):
    mix = mixing.plan(spark, docs, block_words=4)
    blocks = {r.sid: r.n_blocks for r in mix.sources.collect()}
    seen = Counter()
    for r in mix.slots.orderBy("slot").collect():
        assert (r["pass"] * blocks[r.sid] + r.block) == seen[r.sid]
        seen[r.sid] += 1


def test_repeats(spark, docs, rows, none):
    seen = Counter()
    data = [(i, (t or "").encode()) for i, t, _ in rows]
    for _, b in data:
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
    want = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = b"\1" * 400
        rest = bytes(x for x, g in zip(b, gone) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()] += 1
    for options in ({}, {"crowd": 0}, {"shard_bytes": 4000}):
        assert bag(repeats.remove_repeats(spark, docs, **options).collect(), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert repeats.remove_repeats(spark, none).count() == 0


def test_pipeline_cuts_passages_of_51_words(spark):
    from corpus_pipeline import repeated_passages

    rng = random.Random(8)
    words = lambda n: [f"{rng.randrange(10**4)}" for _ in range(n)]
    just, short, wide, lone = words(51), words(50), ["y" * 90 + str(k) for k in range(6)], words(40)
    texts = [words(30) + p + words(20) for p in (just, short, wide, lone) for _ in range(3)] + [words(3000) + just + words(2)]
    texts = [" ".join(t) for t in texts] + ["\n ".join(words(5) + just), "", None]
    seen, data = Counter(), []
    for t in texts:
        b = (t or "").encode()
        at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        data.append((b, at))
        seen.update(b[k : k + 400] for k in range(len(b) - 399))
        seen.update(tuple(b[x:y] for x, y in at[k : k + 51]) for k in range(len(at) - 50))
    want = Counter()
    for b, at in data:
        gone = bytearray(len(b))
        for x, y in [(k, k + 400) for k in range(len(b) - 399) if seen[b[k : k + 400]] > 1] + [(at[k][0], at[k + 50][1]) for k in range(len(at) - 50) if seen[tuple(b[x:y] for x, y in at[k : k + 51])] > 1]:
            gone[x:y] = b"\1" * (y - x)
        want[bytes(x for x, g in zip(b, gone) if not g).decode()] += 1
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = repeated_passages(spark, docs.repartition(3), "").collect()
    assert Counter(r.text for r in got) == want and all(" ".join(just[:40]) not in r.text for r in got)


def thue_morse(k, pair="$5"):
    return "".join(pair[bin(i).count("1") & 1] for i in range(1 << k))


def removed_by_brute_force(texts, length=400):
    data, seen, want = [(t or "").encode() for t in texts], Counter(), []
    for b in data:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        want.append(bytes(x for x, g in zip(b, gone) if not g))
    return want


@pytest.mark.parametrize("crowd", [4096, 3])
def test_regular_texts(spark, crowd):
    """Strings on which polynomial hashes collide, periodic texts, and a frequent passage that is just too short."""
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    flip = str.maketrans("$5", "5$")
    one, middle, long_one = thue_morse(8), letters(128), thue_morse(10)
    texts = [one + middle + one.translate(flip), one.translate(flip) + middle + one, long_one + letters(200), long_one.translate(flip) + letters(200)]
    texts += ["x" * 900, "ab" * 700, letters(300) + "y" * 399, letters(100) + "abc" * 200 + letters(50), "z" * 300_000]
    nearly = letters(390)
    texts += [letters(60) + nearly + letters(60) for _ in range(12)] + [letters(30) + nearly + "k" * 12 + letters(9) for _ in range(5)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in repeats.remove_repeats(spark, docs, with_text=True, crowd=crowd).collect()}
    for k, rest in enumerate(removed_by_brute_force(texts)):
        assert got[k].kept_text == rest.decode() and got[k].n_removed == len(texts[k]) - len(rest), k


def test_word_codes():
    words = [b"a", b"b", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefgh\0", b"a" * 64, b"a" * 65, b"a" * 70, thue_morse(11).encode(), thue_morse(11, "5$").encode()]
    s = np.frombuffer(b" ".join(words) + b"\n" + b"  ".join(words), np.uint8)
    codes = hashing.word_codes(s, *hashing.word_places(s))
    assert (codes[: len(words)] == codes[len(words) :]).all() and len(set(codes.tolist())) == len(words)


def test_suffix_arrays():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(1, 60)).astype(np.uint8)
        want = sorted(range(len(s)), key=lambda i: s[i:].tobytes())
        for symbols in (256, 600):
            assert suffix_array(s, symbols).tolist() == want
        before, lengths = common_prefixes(s, np.array(want), 10**6, np.zeros(len(s), bool))
        for a, b in zip(want, want[1:]):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert before[b] == a and lengths[b] == n


def test_quality(spark, docs, rows, none):
    got = quality.judge(spark, docs).collect()
    want = Counter()
    for i, t, _ in rows:
        t = t or ""
        w, lines, dup = WORD.findall(t), set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in lines
                lines.add(x)
        grams = list(zip(w, w[1:], w[2:]))
        often, held = Counter(grams), set()
        for k, g in enumerate(grams):
            if often[g] > 1:
                held |= {k, k + 1, k + 2}
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(held), len(w) < 50 or 100 * len(held) > 50 * len(w)] += 1
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.judge(spark, none).count() == 0 and quality.kept_rows(spark, docs).columns == docs.columns


def test_quality_verdicts(spark):
    rng = random.Random(1)
    good = ["the", "of", "and", "house", "river", "walks", "green", "to", "in", "is", "that", "stone", "for"]
    bad = ["x$$$", "y###", "&&&z", "%%%", "@q|", "***w"]
    line = lambda pool: " ".join(rng.choice(pool) for _ in range(8)) + "."
    data = [(k, "\n".join(line(good) for _ in range(12))) for k in range(60)] + [(100 + k, "\n".join(line(bad) for _ in range(12))) for k in range(12)]
    got = {r.doc_id: r for r in quality.judge(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(got[k].kept for k in range(60) if not got[k].base_failed) and not any(got[100 + k].kept for k in range(12))


def test_quality_looks_at_whole_texts(spark):
    table, prose = " ".join(f"{k}|{k + 1}" for k in range(450)), "the house of stone and the river is in that land for as long as it was"
    data = [(1, f"{table}\n{prose}"), (2, table), (3, f"{prose}\n{table}")]
    got = {r.doc_id: r.common for r in quality.judge(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_quality_estimation_ends_at_a_fixed_point(spark):
    rng, names = random.Random(4), ["a", "b", "c", "d"]
    right = lambda good: [rng.choice((None, int(good) if rng.random() < 0.75 else int(not good))) for _ in names]
    data = [right(rng.random() < 0.7) for _ in range(2000)]
    fit = quality.estimate(Workspace(spark, "test"), spark.createDataFrame(data, "a int, b int, c int, d int"), names)
    weight = []
    for votes in data:
        yes, no = fit["prior"], 1 - fit["prior"]
        for x, v in zip(names, votes):
            if v is not None:
                yes, no = yes * (fit["good"][x] if v else 1 - fit["good"][x]), no * (1 - fit["bad"][x] if v else fit["bad"][x])
        weight.append(yes / (yes + no))
    assert abs(sum(weight) / len(data) - fit["prior"]) < 1e-6
    for k, x in enumerate(names):
        own = [(w, v[k]) for w, v in zip(weight, data) if v[k] is not None]
        assert abs((sum(w for w, v in own if v) + 1.8) / (sum(w for w, _ in own) + 2) - fit["good"][x]) < 1e-6


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, percent):
    sets, root = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return Counter((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _, _) in enumerate(rows))


@pytest.mark.parametrize("percent, block", [(85, 1024), (80, 8)])
def test_near_duplicates(spark, docs, rows, none, percent, block):
    got = neardup.near_duplicates(spark, docs, percent, block=block, few=block - 8).collect()
    assert bag(got, "id_", "n", "component_id") == components(rows, percent)
    if block == 8:
        assert neardup.near_duplicates(spark, none).count() == 0


def test_signatures_keep_pairs_at_the_threshold():
    """No pair of small sets at 85 of 100 is ruled out by its signatures, or misses all buckets."""
    rng = np.random.default_rng(2)
    for inter, union in ((6, 7), (17, 20), (34, 40), (170, 200)):
        for _ in range(2000):
            u = rng.integers(0, 1 << 63, union, np.uint64) * np.uint64(2)
            h = (union - inter) // 2
            a, b = np.sort(u[: inter + h]), np.sort(np.concatenate([u[:inter], u[inter + h :]]))
            same = neardup.signature(a) == neardup.signature(b)
            assert same.sum() >= neardup.least_agreement(85, np.array([min(len(a), len(b))]))[0]
            assert same.reshape(neardup.BANDS, neardup.ROWS).all(axis=1).any()


def test_components_by_rounds_and_in_one_task(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    one, two = (Counter(map(tuple, union_of(Workspace(spark, "test"), df, "x", few).collect())) for few in (10**6, 0))
    assert one == two and one[160, 100] == one[559, 500] == 1 and not any(node == 7 for node, _ in one)


def test_representatives(spark, docs, rows):
    got = neardup.representatives(spark, docs, 80)
    assert got.columns == docs.columns
    kept = Counter(r.doc_id for r in got.collect())
    want = Counter({i for i, n, c in components(rows, 80) if n and i == c})
    want.update(i for i, n, c in components(rows, 80).elements() if not n)
    assert kept == want


def test_packing(spark, docs, rows, none):
    enc = Encoder(open(tokenizer_path()).read())
    got = packing.pack(spark, docs).collect()
    ids = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t, _ in rows]
    assert sum(r.length for r in got) == sum(map(len, ids))
    by_id = {i: x for (i, _, _), x in zip(rows, ids) if i is not None}
    for r in got:
        if r.doc_id is not None:
            own = by_id[r.doc_id][r.start : r.start + r.length]
            assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(by_id[r.doc_id])
    at = 0
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at
        at += r.length
    assert packing.pack(spark, none).count() == 0


def test_hilbert_neighbours_touch():
    points = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = points[np.argsort(packing.hilbert(points, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all() and len(set(packing.hilbert(points, 3).tolist())) == 512


def test_encoder_equals_tokenizer():
    enc = Encoder(open(tokenizer_path()).read())
    for t in ["a<|endoftext|>b", " " * 9000 + "y", "x" * 9000, "tab\there\x1c y\xa0z\n\n  q", "été 中文 😀 it's"]:
        assert enc.ids(t) == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_token_shards(spark, docs, rows, none):
    got = binary.materialise(spark, docs, per_shard=7, length=64).collect()
    n = len(got)
    assert sorted(r.slot for r in got) == sorted(r.sequence_id for r in got) == list(range(n)) and all(r.shard == r.slot // 7 for r in got)
    enc = Encoder(open(tokenizer_path()).read())
    stream = [i for r in docs.select("text").collect() for i in enc.ids(r.text or "") + [0]]
    stream += [0] * (n * 64 - len(stream))
    want = [zlib.crc32(np.array(stream[k * 64 : k * 64 + 64], "<u4").tobytes()) for k in range(n)]
    assert all(want[r.sequence_id] == r.ids_crc32 for r in got)
    assert binary.materialise(spark, none).count() == 0


def test_shards_resume(spark, docs, tmp_path):
    where = str(tmp_path / "s")
    files, n, width = binary.write_shards(spark, docs, where, per_shard=9, length=64)
    first = {r.file: open(r.file, "rb").read() for r in files.collect()}
    broken = sorted(first)[0]
    open(broken, "wb").write(b"half")
    binary.write_shards(spark, docs, where, per_shard=9, length=64)
    assert {f: open(f, "rb").read() for f in first} == first
    late = binary.read_shards(files, n, width, 64, 9, start=10).collect()
    assert sorted(r.slot for r in late) == list(range(10, n))


def test_results_do_not_hang_on_splits(spark, docs, tmp_path):
    """The same files read in few and in many partitions: equal shards of documents and equal shards of token ids."""
    for k, part in enumerate(docs.where("doc_id IS NOT NULL").randomSplit([5.0, 1.0, 3.0], 2)):
        part.coalesce(1).write.option("parquet.block.size", 4096).parquet(str(tmp_path / f"p{k}"))
    was, got = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for size, cost in (("128m", "4m"), ("3000", "1")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            read = spark.read.parquet(*[str(tmp_path / f"p{k}") for k in range(3)])
            rows = lambda df: sorted(map(tuple, df.collect()), key=str)
            got.append((read.rdd.getNumPartitions(), rows(sharding.shard(spark, read)), rows(binary.materialise(spark, read, per_shard=7, length=64))))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[0][0] != got[1][0] and got[0][1:] == got[1][1:]


def test_shards_of_changed_input_are_written_anew(spark, tmp_path):
    where = str(tmp_path / "s")
    make = lambda last: spark.createDataFrame([(k, f"text {k} of some words") for k in range(40)] + [(40, last)], "doc_id long, text string")
    read = lambda docs, **more: [tuple(r) for r in binary.read_shards(*binary.write_shards(spark, docs, where, per_shard=3, length=16, **more), 16, 3, **more).orderBy("slot").collect()]
    one, two, other_key = read(make("one end")), read(make("two end")), read(make("one end"), key=7)
    assert len(one) == len(two) == len(other_key) and one != two and one != other_key
    assert {r[2]: r[4] for r in one} == {r[2]: r[4] for r in other_key} and read(make("one end")) == one


def longest_match(word, first, rest):
    """Greedy word pieces by trying every length; -1 if they don't cover the word."""
    data, at, n = b" " + word, 0, 0
    while at < len(data):
        size = next((k for k in range(len(data) - at, 0, -1) if data[at : at + k] in (rest if at else first)), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def test_token_counts_equal_longest_match(spark, docs, rows, tmp_path):
    small = [b" ", b" a", b" ab", b"b", b"bc", b"cde", b"d", b"e", b" the", b"re", b"a", b"aa", b"aab"]
    (tmp_path / "v").write_bytes(b"\n".join(base64.b64encode(x) + b" %d" % k for k, x in enumerate(small)))
    own = [(k, t) for k, t in enumerate(["abcde there aab aaaab abx  bcde", "\u00e9 a\u00a0b", "x" * 3000, "aab" * 900, "a\x0bb\fc"])]
    for path, frame, texts in ((str(tmp_path / "v"), spark.createDataFrame(own, "doc_id long, text string"), own), (counts.vocabulary_path(), docs, [(i, t) for i, t, _ in rows])):
        pieces = [base64.b64decode(line.split()[0]) for line in open(path, "rb") if line.strip()]
        first, rest = {x for x in pieces if x[:1] == b" "}, {x for x in pieces if x[:1] != b" "}
        want = Counter()
        for i, t in texts:
            n = [longest_match(w, first, rest) for w in (t or "").encode().split()]
            want[i, len((t or "").encode()), len(n), sum(x if x >= 0 else 1 for x in n), n.count(-1)] += 1
        assert bag(counts.token_counts(spark, frame, path).collect(), "doc_id", "n_bytes", "n_words", "n_tokens", "n_unknown") == want


def test_token_counts(spark, docs, rows, none):
    machine = counts.Automaton([b" ab", b" a", b" "], [b"a", b"b", b"bb", b"abc"])
    assert [machine.count(w) for w in (b" ab", b" abc", b" abbb", b" q", b" aabc")] == [1, -1, 2, -1, 2]
    got = counts.token_counts(spark, docs).collect()
    assert bag(got, "doc_id", "n_words") == Counter((i, len((t or "").encode().split())) for i, t, _ in rows)
    assert all(r.n_words <= r.n_tokens <= r.n_bytes for r in got) and counts.token_counts(spark, none).count() == 0


def test_sharding(spark, docs, rows, none):
    got = sharding.shard(spark, docs).collect()
    assert bag(got, "doc_id", "size", "text_crc32") == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and sharding.shard(spark, none).count() == 0
    many = spark.createDataFrame([(k, f"single {k} " * (k % 9 + 1) if k % 4 else f"group {k // 40}") for k in range(800)], "doc_id long, text string")
    got = sharding.shard(spark, many).collect()
    loads = Counter()
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 0.05 * sum(loads.values()) / 8 + 200
    homes = {}
    for r in got:
        if r.doc_id % 4 == 0:
            homes.setdefault(r.doc_id // 40, set()).add(r.shard)
    assert sum(len(h) == 1 for h in homes.values()) >= len(homes) // 2


def test_top_k(spark):
    rng = np.random.default_rng(2)
    e = [(k, rng.normal(size=16).tolist()) for k in range(300)] + [(1000 + k, [0.5] * 16) for k in range(100)]
    e += [(2000, None), (2050, [float("inf")] * 16), (2100, []), (None, [9.0] * 16), (2150, [0.5, 0.25]), (2152, [0.5, 0.75]), (2200, [None] * 16)]
    df = spark.createDataFrame([(a, b, 1) for a, b in e], "vec_id long, embedding array<float>, score int")
    use = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in e if i is not None and v and None not in v and np.isfinite(v).all()]
    want = Counter()
    for i, v in use:
        if i % 50 == 0:
            best = sorted((-int(v @ w), j) for j, w in use if j != i and len(w) == len(v))[:5]
            want.update((i, k, j, -s) for k, (s, j) in enumerate(best, 1))
    for options in ({}, {"query_block": 3, "block": 20}):
        assert bag(topk.top_k(spark, df, F.col("vec_id") % 50 == 0, **options).collect(), "query_id", "rank", "vec_id", "score") == want
    assert topk.top_k(spark, df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_warc(spark):
    big = "é" * 600
    pages = [(1, "http://a b\n", None), (2, None, ""), (3, "u", big), (9, "u", big), (5, "u", big), (None, "u", big), (7, "s", "small"), (8, "s", "small"), (10, "v", "\r\n\r\nWARC/1.1\r\n" * 200)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in pages], "page_id long, url string, html string, digest string")
    top = {big: 9}
    want = Counter()
    for i, _, t in pages:
        t = t or ""
        again = t in top and top[t] != i
        want[i, len(t.encode()), hashlib.sha1(t.encode()).hexdigest(), "revisit" if again else "response", top[t] if again else None] += 1
    assert bag(warc.archive_and_read(spark, df).collect(), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert warc.archive_and_read(spark, df.limit(0)).count() == 0
    data = b"".join(zlib.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * k, wbits=31) for k in (1, 2))
    for size in (1, 5, len(data)):
        assert len(list(warc.records(warc.inflated((data[k : k + size] for k in range(0, len(data), size)), 7)))) == 3
    assert list(warc.inflated([])) == []
    with pytest.raises(EOFError):
        list(warc.inflated([data[:-3]]))


def test_warc_archives_roll_and_joins_agree(spark, tmp_path):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh \n") for _ in range(rng.choice((0, 30, 1500, 4000)))) for _ in range(60)]
    texts.append("long " * 600_000)
    pages = [(k, f"http://h/{k}", rng.choice(texts)) for k in range(300)] + [(1000, "u", texts[-1]), (1001, "u", texts[-1])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)
    top = {}
    for i, _, t in pages:
        top[t] = max(i, top.get(t, i))
    want = Counter()
    for i, _, t in pages:
        again = len(t) >= 1000 and top[t] != i
        want[i, len(t), hashlib.sha1(t.encode()).hexdigest(), "revisit" if again else "response", top[t] if again else None] += 1
    for few in (0, 1000):
        at = str(tmp_path / str(few))
        warc.write(df, at, few_repeats=few)
        files = warc.normalise(spark, f"{at}/monolithic", f"{at}/archives", archive_bytes=20_000).collect()
        assert len(files) > 4 and sum(f.records for f in files) == len(pages)
        read = warc.read(warc.index(spark, f"{at}/archives")).collect()
        assert bag(read, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
        assert {r.archive for r in read} == {f.archive for f in files}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    good = ["the", "of", "and", "house", "river", "walks", "green", "to", "in", "is", "that", "stone", "for", *["w" + "".join(rng.choice("aeioubdt") for _ in range(5)) for _ in range(300)]]
    line = lambda n: " ".join(rng.choice(good) for _ in range(n)) + "."
    passage = line(100)
    texts = ["\n".join(line(12) for _ in range(8)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more"] + [f"{line(60)}\n{passage}\n{line(60)}" for _ in range(3)] + ["$$$ ### " * 60, None]
    spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    ids = {n: {r.doc_id for r in v} for n, v in seen.items()}
    assert ids["quality_rules"] == set(range(45)) and ids["near_duplicates"] == set(range(45)) - {40, 41}
    assert not any(passage[:200] in r.text for r in seen["repeated_passages"]) and ids["repeated_passages"] == ids["near_duplicates"]
    assert sum(r.length for r in seen["packing"]) > 0


def test_top_k_of_very_long_vectors(spark):
    """Components up to the largest finite ones; several passes and query blocks."""
    rng = random.Random(9)
    big = lambda: [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([0, 1, 5, 7, 9, 30, 200]) for _ in range(4)]
    rows = [(k, [rng.uniform(-9, 9) for _ in range(4)]) for k in range(60)] + [(k, big()) for k in range(60, 100)] + [(100, [1.7e308] * 4), (101, [5e5, 0.0, 0.0, 0.0]), (102, [float("inf")] * 4)]
    most = (1 << 63) - 1
    with np.errstate(over="ignore"):
        whole = {i: [int(np.floor(np.clip(256 * np.float64(x), -topk.LARGEST, topk.LARGEST))) for x in v] for i, v in rows if i != 102}
    want = set()
    for q in (i for i in whole if i % 10 == 0):
        scored = sorted((-max(-most - 1, min(most, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in whole if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for block in (4096, 2):
        assert {tuple(r) for r in topk.top_k(spark, table, F.col("vec_id") % 10 == 0, query_block=block, block=16).collect()} == want


def test_top_k_reads_longer_vectors_after_shorter_ones(spark):
    short, long_ = [(k, [1, k % 3]) for k in range(8)], [(k, [90, k]) for k in range(8, 16)]
    data = [(k, k, x * x + y * y, np.array([x, y], "<i4").tobytes()) for k, (x, y) in short + long_]
    dealt = spark.createDataFrame(data, "uid long, vec_id long, norm2 long, v binary").coalesce(1)
    chosen = {"v": np.array([[100.0, 1.0]]), "uid": np.array([-1]), "least": np.array([8000.0])}
    share = spark.sparkContext.broadcast
    got = topk._pass(dealt, share([chosen]), share(np.eye(2)), 2, 3, 4).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: -r.score)] == [(15, 9015), (14, 9014), (13, 9013)]


def test_neighbours_on_the_curve_are_alike(spark):
    rng = random.Random(3)
    topics = [[f"{a}{k}" for k in range(60)] for a in ("red", "blue", "green", "grey", "pink")]
    rows = [(k, " ".join(rng.choice(topics[k % 5]) for _ in range(rng.randint(60, 160)))) for k in range(300)]
    got = packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    order = [r.doc_id % 5 for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    alike = sum(a == b for a, b in zip(order, order[1:])) / (len(order) - 1)
    assert alike > 0.2 + 5 * (0.2 * 0.8 / len(order)) ** 0.5, alike  # one in five by chance, and five standard deviations


def test_each_source_comes_near_its_target(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.randint(1, 80)), f"s{min(k % 40, rng.randrange(40))}") for k in range(1500)]
    got = mixing.taken(mixing.plan(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    taken, target, size = Counter(), {}, {}
    for r, (_, _, source) in zip(sorted(got, key=lambda r: r.doc_id), rows):
        taken[source] += r.taken
        target[source], size[source] = r.target, r.source_size
        assert r.taken <= 3 * r.size
    for source in target:
        assert abs(taken[source] - target[source]) <= max(16, size[source] / 16) + 1, (source, taken[source], target[source])


def test_stages_take_awkward_tables(spark):
    """No rows; null ids, texts and sources; repeated rows; a column that documents don't have."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, mix_at_ int"
    rng = random.Random(1)
    good = " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(120)) + ". The end of it is that the one was for you."
    rows = [(None, None, None, None, None, 1), (None, good, "en", None, 5, 1), (3, good, "en", "a", 5, 1), (3, good, "en", "a", 5, 1), (4, "", "en", "a", 0, 1), (5, good + " and more", None, "b", 5, None)]
    for table in ([], rows):
        docs = spark.createDataFrame(table, schema)
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "")
            assert name == "packing" or got.columns == list(corpus_pipeline.COLUMNS), name
            kept = got.collect()
            assert bool(kept) == bool(table) or name == "quality_rules", name
            if table and name == "near_duplicates":
                assert sum(r.text is not None and len(r.text) > 99 for r in kept) == 1
            if table and name == "repeated_passages":
                assert len(kept) == len(rows) and all(len(r.text) < 99 for r in kept)
