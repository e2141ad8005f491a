"""Fill-in-middle, manifest and language operators against plain models."""

import random
import re

from quillon.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_model(doc_id, text):
    u, h = UNIT.findall(text), fim.draws(doc_id)
    n = len(u)
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def test_fill_in_middle_equals_the_model():
    r = random.Random(7)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "漢", "😀", "<", "P", ">", "<P", "S>", "<M>", "\x85", " ", "word", "\x1c"]
    texts = ["", " ", "<P>", "x" * 5000, " " * 700, "é" * 1000 + " b"] + ["".join(r.choices(parts, k=r.choice((1, 3, 10, 255, 256, 257, 700, 3000)), weights=[5] * 10 + [2] * 4 + [0.01] + [2] * 4)) for _ in range(600)]
    got = fim.transformed(list(range(len(texts))), [t.encode() for t in texts])
    assert [(*g[:4], g[4].decode()) for g in got] == [fim_model(i, t) for i, t in enumerate(texts)]
    assert len({g[1] for g in got}) == 3


def test_fill_in_middle_rows(spark):
    from pyspark.sql import functions as F

    texts = [None, "", "one two  three\n", "q <S> r", "a " * 50_000 + "end", "wörd " * 9]
    rows = spark.createDataFrame([(i, t, "clash", 1) for t in texts for i in (1, 2, 3, 5, 5, None)], "doc_id long, text string, output string, n long")
    got = fim.fill_in_middle(rows).withColumn("again", fim.restored(F.col("form"), F.col("output"))).collect()
    want = sorted((str(i), *map(str, fim_model(i, t or "")), t or "") for t in texts for i in (1, 2, 3, 5, 5, None))
    assert sorted((str(r.doc_id), *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output)), r.again) for r in got) == want
    assert fim.fill_in_middle(rows.where("false")).count() == 0


def tree_model(nodes):
    from quillon.llm.merkle import sha

    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def beside(tree, p):
    return [("".join(t[p // 3**k // 3 * 3 : p // 3**k]), "".join(t[p // 3**k + 1 : p // 3**k // 3 * 3 + 3])) for k, t in enumerate(tree[:-1])]


def test_traversal_equals_the_whole_tree():
    from quillon.llm.merkle import block_root, fold, levels, paths, sha

    for n in [*range(1, 60), 81, 82, 243, 244, 500]:
        leaves = [sha(str(i)) for i in range(n)]
        tree = tree_model(leaves)
        assert levels(n) == len(tree) - 1 and block_root(leaves, levels(n)) == tree[-1][0]
        for height in (1, 2, 3):
            assert list(paths(leaves, levels(n), height)) == [beside(tree, p) for p in range(n)]
        assert all(fold(leaf, path) == tree[-1][0] for leaf, path in zip(leaves, paths(leaves, levels(n)), strict=True))


def test_manifest(spark):
    """Sources of many blocks and rounds, nulls, equal numbers, repeated rows and a long text, against a model on the driver."""
    import zlib

    from quillon.llm import merkle

    rows = [(i, f"line\n{i}", "en", "a", i) for i in range(100)] + [(i, None if i % 2 else "", None, None, None) for i in range(7)] + [(3, "x", "de", "é", 1), (3, "y\n", "de", "é", 1), (3, "y\n", "de", "é", 1), (None, "z\n", "de", "é", 1), (4, "long\n" * 100_000, "de", "z", 1)]
    rows += [(i, f"t\n{i}", "fr", f"s{i}", 0) for i in range(12)]
    df = spark.createDataFrame([(*r, "h", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string, idx int")
    enc = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, g, s, n: merkle.sha(*map(enc, (i, s, g, n, t)))
    groups = {}
    for i, t, g, s, n in rows:
        now = t if t is None or i is None or zlib.crc32(str(i).encode()) % 2 else t.replace("\n", "")
        groups.setdefault(s, []).append((i is not None, i or 0, leaf(i, t, g, s, n), leaf(i, now, g, s, n), i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:4])
        trees[s] = tree_model([x[2] for x in groups[s]])
    top = tree_model([trees[s][-1][0] for s in names])
    want = []
    for k, s in enumerate(names):
        for p, (_, _, h, now, i) in enumerate(groups[s]):
            path = beside(trees[s], p) + beside(top, k)
            folded = merkle.fold(now, path)
            want.append((i, h, trees[s][-1][0], top[-1][0], merkle.sha(*[a + b for a, b in path]), folded, folded == top[-1][0]))
    assert sorted(map(tuple, merkle.manifest(spark, df.repartition(3), 2).collect()), key=str) == sorted(want, key=str)
    assert merkle.manifest(spark, df.where("false")).count() == 0
    one = merkle.manifest(spark, df.where("doc_id = 4 AND source = 'z'")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == merkle.sha()


def grams_model(text):
    """The n-grams themselves: letters in lower case, everything else one space."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = f" {' '.join(words)} "
    return [line[i : i + 3] for i in range(len(line) - 2)] if words else []


def test_grams_and_mixture():
    import numpy as np

    from quillon.llm import language

    texts = ["Hello, World!", "a", "", None, "12 34", "é ß 漢字 x", "one  two\n\nthree.", "!a", "İ", "z" * 5000]
    for t in texts:
        _, n = language.grams(t)
        assert n.sum() == len(grams_model(t)) and len(n) == len(set(grams_model(t))), t
    r = np.random.default_rng(1)
    for _ in range(40):
        p = r.dirichlet(np.full(300, 0.3), 4)
        truth = r.dirichlet([0.4] * 4)
        n = r.multinomial(3000, truth @ p).astype(float)
        at = n > 0
        # The estimate is the best mixture: no step towards any language helps.
        value, theta = language.shares(p[:, at], n[at], np.full(4, 0.25))
        assert abs(theta.sum() - 1) < 1e-9 and (p[:, at] @ (n[at] / (theta @ p[:, at]))).max() - n.sum() < 1.001e-2
        # Greedy growth ends where no other language repays its penalty, by full estimation of each.
        chosen, theta = language.mixture(p[:, at], n[at])
        price = 3 * 0.5 * np.log(n.sum() / 3)
        now = language.shares(p[chosen][:, at], n[at], np.full(len(chosen), 1 / len(chosen)))[0]
        for k in set(range(4)) - set(chosen):
            assert language.shares(p[[*chosen, k]][:, at], n[at], np.full(len(chosen) + 1, 1 / (len(chosen) + 1)))[0] - now <= price + 2e-2


def test_languages_of_documents(spark):
    import zlib

    from quillon.llm.language import held_out_identification, identify, learn

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = held_out_identification(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    names, p = learn(docs)
    text = {r.lang: r.text for r in docs.where("length(text) BETWEEN 1500 AND 2500").dropDuplicates(["lang"]).collect()}
    rows = spark.createDataFrame([(1, text["en"] + text["de"], "q"), (2, text["fr"] * 40, "q"), (3, None, "q"), (4, "12 !", "q"), (5, "", "q"), (5, "", "q"), (None, text["es"], "q")], "doc_id long, text string, lang_pred string")
    found = {r.doc_id: r for r in identify(spark, rows, names, p).collect()}
    assert {x.lang for x in found[1].languages} == {"en", "de"} and 0.3 < found[1].score < 0.7
    assert [found[k].lang_pred for k in (2, 3, 4, 5, None)] == ["fr", "und", "und", "und", "es"] and found[3].score == 0
    unlabelled = spark.createDataFrame([(1, "some words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in held_out_identification(spark, unlabelled).collect()} == {("und", 0.0)}
    assert held_out_identification(spark, unlabelled.where("false")).count() == 0
