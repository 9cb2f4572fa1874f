"""Near-duplicates, repeated passages and URL rules against plain Python."""

import random

import brute
import numpy as np
import pytest

from meshframe.llm import common, embeddings, minhash, substring, url_filter, wordhash

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def joined(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 200)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = joined(edges, {x for e in edges for x in e})
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k not in loops}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near(rng, v, cosine):
    v = v / np.linalg.norm(v)
    n = rng.normal(size=len(v))
    n -= (n @ v) * v
    return (cosine * v + np.sqrt(1 - cosine**2) * n / np.linalg.norm(n)).astype(np.float32)


def vector_rows(width=64):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(25):
        v = rng.normal(size=width)
        for cosine in (1.0, 0.995, 0.985, 0.9801, 0.975, 0.9):
            rows.append((len(rows), near(rng, v, cosine), c % 3))
    copy = rows[3][1]
    rows += [(len(rows) + i, copy, 0) for i in range(5)]
    return [(i, [float(x) for x in v], label) for i, v, label in rows]


@pytest.mark.parametrize("width", [64, 48])
def test_vectors(spark, width):
    rows = vector_rows(width)
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    want = joined(zip(*np.nonzero(link)), range(len(rows)))
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"], r["kept"]) == (link[i].sum(), want[i], want[i] == i)


def test_vector_edges(spark):
    x = [0.5] * 64
    rows = [(0, x, 1), (1, x, 1), (2, x, 2), (3, x, None), (4, None, 1), (5, [], 1), (6, [0.0] * 64, 1), (7, [NAN] * 64, 1),
            (8, [INF] + [0.0] * 63, 1), (9, [None] + x[1:], 1), (None, x, 1), (10, [1e-30] * 64, 1), (11, x[:3], 1), (12, [-1.0] * 64, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect()}
    assert got[0] == (3, 0, True) and got[1] == (3, 0, False) and got[10] == (3, 0, False) and got[None] == (2 + 1, 0, False)
    assert all(got[i] == (0, i, True) for i in (2, 3, 4, 5, 6, 7, 8, 9, 11, 12))
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(embeddings.rotate(x, 3), axis=1), np.linalg.norm(x, axis=1))


def test_window_hashes():
    h = np.random.default_rng(0).integers(0, 2**63, 200).astype(np.uint64)
    for width in (1, 2, 5, 15, 35):
        out = wordhash.window_hashes(h, width)
        assert len(out) == 200 - width + 1 and len(set(out.tolist())) == len(out)
        again = wordhash.window_hashes(np.concatenate([h[100:100 + width], h]), width)
        assert again[0] == out[100] and again[width + 7] == out[7]
    assert len(wordhash.window_hashes(h[:3], 5)) == 0


def plain_similarity(a, b):
    x, y = (dict(zip(*map(np.ndarray.tolist, minhash.shingles(t.encode())))) for t in (a, b))
    common_ = x.keys() & y.keys()
    both = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in both) for i in common_)


def test_probability_jaccard():
    rng = random.Random(0)
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice("abcde")
        a, b = " ".join(a), " ".join(b)
        (sa, wa), (sb, wb) = minhash.shingles(a.encode()), minhash.shingles(b.encode())
        assert minhash.probability_jaccard(sa, wa, sb, wb) == pytest.approx(plain_similarity(a, b))


def copies(rng, n, length, edits, tag):
    base = [f"{tag}{rng.randrange(900)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_near_copies_with_a_large_loose_group(spark):
    rng = random.Random(7)
    texts = copies(rng, 150, 120, 6, "a") + copies(rng, 6, 60, 2, "b") + copies(rng, 5, 400, 12, "c")
    texts += [" ".join(f"z{rng.randrange(10**6)}" for _ in range(80)) for _ in range(40)]
    texts += ["few words", "few  words\n", "few", "one two three four five", "w " * 300, "w " * 310, "", " ", None, texts[0], texts[0]]
    want = joined(
        [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] and texts[j] and texts[i].split() and texts[j].split()
         and (texts[i] == texts[j] or plain_similarity(texts[i], texts[j]) >= 0.8 - 1e-9)], range(len(texts)))
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = minhash.near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    kept = minhash.drop_near_duplicates(df.union(df.where("doc_id < 3")))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want.items() if i == c)
    assert kept.columns == df.columns


def test_near_copy_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (7, "x y z u v w"), (None, "x y z u v w")], "doc_id long, text string")
    got = sorted((r["class_id"] or -1, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [(-1, True), (-1, True), (7, False), (7, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_covers():
    for period, places in substring.COVERS.items():
        assert {(a - b) % period for a in places for b in places} == set(range(period))
    assert substring.cover(35) == (21, 15)


def check_repeats(rows, texts):
    want = brute.repeats(texts)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]


def test_repeats(spark):
    rng = random.Random(3)
    passages = [[f"p{rng.randrange(10**6)}" for _ in range(n)] for n in (34, 35, 36, 55, 56, 90, 200)]
    texts = {}
    for i in range(150):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = p
        texts[i] = " ".join(words)
    texts |= {200: None, 201: "", 202: " \n", 203: "x " * 34, 204: "y " * 35, 205: "y " * 80, 206: "é ü\u00a0ß " * 40, 207: texts[5], 208: texts[5],
              209: " ".join(passages[4]), 210: "\t".join(passages[4]), 211: "q " * 20000}
    df = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, n_words int")
    check_repeats(substring.remove_repeats(df).collect(), texts)


def test_repeats_of_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = substring.remove_repeats(spark.createDataFrame([(None, text), (None, text), (1, "a b")], "doc_id long, text string")).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(2, 0), (50, 50), (50, 50)]
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    check_repeats(substring.op4_substring_dedup(spark, SF).collect(), docs)


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net/x", "http://anet/x", "http://x.example.net/en/1?q#f",
    "http://example.net/en", "http://example.net/en/", "https://www.example.com/de/1", "http://example.com/fr/", "s://org/fr/1", "s://a.org/fr", "s://b.a.org/fr/#x",
    "http://x.net?y=/", "http://x.net#/", "a://b://c.net/", "http://É.Net/en/", "http://.net/", "http://net./", "http://example.net:80/en/", "x\n://y.net/\n",
]


def plain_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules(spark):
    rng = random.Random(1)
    hosts = ["net", "a.net", "b.a.net", "org", "c.org", "a-b.net", "anet"]
    paths = ["/", "/x/", "/x/y", "", "/xy"]
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.6}.values())
    urls = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'z', '?q', '#x', '/x/y/z'])}" for _ in range(400)] + URLS
    for used in (rules, url_filter.RULES, []):
        table = url_filter.rule_table(spark, used) if used else url_filter.rule_table(spark).limit(0)
        df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(5)
        got = url_filter.apply_rules(df, table).collect()
        assert len(got) == len(urls)
        for r in got:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_rule(urls[r["page_id"]], used), urls[r["page_id"]]


def test_no_urls(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.apply_rules(df, url_filter.rule_table(spark)).count() == 0
