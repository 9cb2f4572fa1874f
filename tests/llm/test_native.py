"""PII, quality, mixing and shards against plain Python, on given tables and on edge rows."""

import math
import random
from fractions import Fraction

import brute
import pytest
from pyspark.sql import functions as F

from meshframe.llm import mixing, pii, quality, sharding

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n\n", "a", "a@b.c", "x@y.z%foo@bar.com", "a@b", "q@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0255",
    "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111  1111 1111", "4242424242424242424", "12345678901234567890",
    "+1 (499) 555-6503%%%", "+12", "+1+2 345 678 9012", "+1 2345678901234567", "é+33 1 23 45 67 89 ü@é.fr u@x.fr", " b c",
    "call 212-555-0187 or (212) 555-0188, visa 4111 1111 1111 1112", "line\nline\r\nline\n \nline", "one two " * 30,
    "é" * 50 + " " + "ab " * 7, "#*$%&|<> a", "9" * 5000, "a" * 5000 + "@", "1." * 3000, ("x%d@y.com " * 700) % tuple(range(700)),
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")


def check_pii(rows, texts):
    for r in rows:
        want = brute.pii(texts[r["doc_id"]])
        assert [s for s in r["base"].split(",") if s] == want["listed"], texts[r["doc_id"]]


def test_pii_base_on_edge_rows_and_noise(spark):
    rng = random.Random(5)
    noise = ["".join(rng.choice("12345 .-+@a_b()%\n") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts = TEXTS + noise
    got = pii.candidates(frame(spark, texts)).withColumn("base", pii.render(F.filter("cands", lambda c: c["base"])))
    check_pii(got.select("doc_id", "base").collect(), texts)


def test_pii_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii_rows = __import__("meshframe.llm.registry", fromlist=["QUERIES"]).QUERIES["op6_pii"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in pii_rows:
        want = brute.pii(docs[r["doc_id"]])
        assert all(r[k] == want[k] for k in want if k != "listed")
        assert set(want["listed"]) <= set(r["spans"].split(",")) | {""}


def test_pii_adds_what_labelers_agree_on_and_redacts(spark):
    texts = [f"call +1 212 555 0{i:03d} or mail u{i}@site.com, phone 212-555-1{i:03d}" for i in range(60)]
    texts += [f"order 212-555-1{i:03d}, version 1.2.3.{300 + i}" for i in range(60)]
    cands = pii.candidates(frame(spark, texts))
    found = pii.decide(cands, pii.train(cands)).withColumns(
        {"out": pii.redact(F.col("text"), F.col("spans")), "listed": pii.render(F.col("spans"))})
    rows = {r["doc_id"]: r for r in found.collect()}
    assert all(rows[i]["out"] == "call [PHONE] or mail [EMAIL], phone [PHONE]" for i in range(60))
    assert all(rows[i]["out"] == texts[i] for i in range(60, 120))


def test_pii_without_rows(spark):
    cands = pii.candidates(frame(spark, []))
    assert pii.decide(cands, pii.train(cands)).count() == 0
    none = pii.candidates(frame(spark, ["no data", None]))
    assert [r["spans"] for r in pii.decide(none, pii.train(none)).collect()] == [[], []]


def test_quality_counts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for rows, texts in (
        (quality.text_features(frame(spark, TEXTS)).collect(), dict(enumerate(TEXTS))),
        (quality.op9_quality(spark, SF).collect(), docs),
    ):
        assert len(rows) == len(texts)
        for r in rows:
            want = brute.quality(texts[r["doc_id"]])
            assert {k: r[k] for k in want} == want
            assert not (want["base_failed"] and r.asDict().get("kept"))


def test_binomial_tail_is_exact(spark):
    cases = [(0, 100), (3, 1000), (10, 3000), (30, 10000), (0, 1), (400, 100000), (5, 100)]
    rows = spark.createDataFrame(cases, "k long, n long")
    p = 0.005
    for r in rows.withColumn("t", quality.binomial_tail(F.col("k"), F.col("n"), p)).collect():
        want = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1)
                            + i * math.log(p) + (r["n"] - i) * math.log1p(-p)) for i in range(r["k"] + 1))
        assert r["t"] == pytest.approx(want if r["k"] < r["n"] * p else 1.0, rel=1e-8)


def labelled_rows(n_good, n_bad, bad_share, lang="x"):
    row = lambda good, share: (lang, good, False, share, 0.0, 0.0, 0.0)
    return [row(1, 0.0)] * n_good + [row(0, bad_share)] * n_bad


def cutoffs(spark, rows):
    shares = ", ".join(f"{r} double" for r in quality.RULES)
    return {r["stratum"]: r["max_symbol_share"] for r in quality.select_cutoffs(
        spark.createDataFrame(rows, f"lang string, quality int, base_failed boolean, {shares}"), "lang", "quality").collect()}


def tail(k, n, p):
    """P(X <= k), exactly."""
    if k >= n * p:
        return 1.0
    return float(sum(math.comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))


def plain_cutoffs(rows, risk=quality.MAX_FALSE_REJECTION, delta=quality.DELTA):
    """Cutoff of each stratum from (stratum, good, base_failed, shares)."""
    used = [(s, g == 1, max(shares)) for s, g, failed, *shares in rows if g is not None and not failed]
    strata = {s for s, _, _ in used}
    good = {s: sum(g for t, g, _ in used if t == s) for s in strata}
    unit = {s: ("pool" if (1 - risk) ** good[s] * len(strata) > delta else "own", s) for s in strata}
    unit = {s: ("pool", None) if u[0] == "pool" else u for s, u in unit.items()}
    tails, steps = {}, {}
    for u in set(unit.values()):
        mine = [(g, x) for s, g, x in used if unit[s] == u]
        steps[u] = [(sum(g and x > c for g, x in mine), sum(not g and x > c for g, x in mine)) for c in quality.CUTOFFS]
        tails[u] = [tail(false, sum(g for g, _ in mine), risk) for false, _ in steps[u]]
    still = len(tails)
    for w in sorted(max(t) for t in tails.values()):
        if w * still <= delta:
            still -= 1
        else:
            break
    out = {}
    for u, t in tails.items():
        fine = next((j for j, x in enumerate(t) if x * max(still, 1) > delta), len(t))
        worth = [(caught - quality.COST * false, -j) for j, (false, caught) in enumerate(steps[u][:fine])]
        best = max([w for w in worth if w[0] > 0], default=None)
        out[u] = quality.CUTOFFS[-best[1]] if best else None
    return {s: out[unit[s]] for s in strata}


def test_cutoffs_need_enough_labels_and_keep_the_risk(spark):
    assert cutoffs(spark, labelled_rows(3000, 50, 0.35)) == {"x": 0.3}
    assert cutoffs(spark, labelled_rows(300, 50, 0.35)) == {"x": 0.3}
    assert cutoffs(spark, labelled_rows(100, 50, 0.35)) == {"x": None}
    # 1 % of the good ones look bad: within the risk, but not worth it; 3 %: beyond the risk.
    assert cutoffs(spark, labelled_rows(3000, 50, 0.35) + [("x", 1, False, 0.35, 0.0, 0.0, 0.0)] * 30) == {"x": None}
    assert cutoffs(spark, labelled_rows(3000, 900, 0.35) + [("x", 1, False, 0.35, 0.0, 0.0, 0.0)] * 30) == {"x": 0.3}
    assert cutoffs(spark, labelled_rows(3000, 900, 0.35) + [("x", 1, False, 0.35, 0.0, 0.0, 0.0)] * 90) == {"x": None}
    assert cutoffs(spark, labelled_rows(3000, 50, 0.35, None)) == {None: 0.3}
    assert cutoffs(spark, []) == {}


def test_small_strata_are_certified_together(spark):
    rows = [r for s in "abcd" for r in labelled_rows(90, 10, 0.35, s)]
    assert cutoffs(spark, rows) == dict.fromkeys("abcd", 0.3)
    assert cutoffs(spark, rows[:100]) == {"a": None}
    assert cutoffs(spark, rows + labelled_rows(5000, 20, 0.55, "z")) == {**dict.fromkeys("abcd", 0.3), "z": 0.5}


def test_cutoffs_as_in_plain_python(spark):
    rng = random.Random(8)
    for trial in range(4):
        rows = []
        for s, n in (("en", 2500), ("de", 500), ("es", 320), ("fr", 60), (None, 80)):
            for _ in range(n):
                g = 1 if rng.random() < 0.85 else 0
                share = lambda g=g: round(rng.choice([0.0, 0.01, 0.05]) if g and rng.random() > 0.003 * trial else rng.random() ** 2, 3)
                rows.append((s, rng.choice([g] * 20 + [None]), rng.random() < 0.05, share(), share(), share(), share()))
        assert cutoffs(spark, rows) == plain_cutoffs(rows), trial


def test_uncertifiable_strata_stay_free_nearly_always():
    """Strata with 2.5 % of good rows above every cutoff are certified in less than delta of all draws."""
    rng = random.Random(9)
    n, p, wrong = 1000, 0.025, 0
    for _ in range(400):
        false = sum(rng.random() < p for _ in range(n))
        wrong += tail(false, n, quality.MAX_FALSE_REJECTION) <= quality.DELTA
    assert wrong <= 0.05 * 400


def test_quality_edges(spark):
    rows = quality.text_features(frame(spark, [None, "w " * 30, " ".join(f"w{i}" for i in range(40))]))
    none = quality.select_cutoffs(rows.limit(0).withColumns({"quality": F.lit(1), "lang": F.lit("x")}), "lang", "quality")
    got = quality.judge(rows.withColumn("lang", F.lit(None).cast("string")), none, "lang").orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == [False, False, True]


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, n int, size string")
    return mixing.mix(df, F.col("source"), F.col("n"), F.col("doc_id").cast("string"))


def test_mix_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", "c", "d", None]) if i % 3 else "a", rng.choice([0, 5, 20, 90, 700]), "clash") for i in range(4000)]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[1]] = sizes.get(r[1], 0) + r[2]
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["size"] * r["copies"]
    assert all(abs(taken[s] - want[s]) <= 20 for s in sizes), (taken, want)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixed(spark, rows).collect()), key=repr)


def test_mix_edges(spark):
    assert mixed(spark, []).count() == 0
    assert [r["copies"] for r in mixed(spark, [(1, None, 0, "")]).collect()] == [0]
    one = mixed(spark, [(1, "a", 10, "")]).collect()
    assert one[0]["target"] == 15 and one[0]["copies"] == 1
    same = mixed(spark, [(None, "a", 4, "")] * 30 + [(7, "b", 100, "")]).collect()
    assert len(same) == 31 and len({r["copies"] for r in same if r["source"] == "a"}) == 1


def test_mix_with_clashing_names_ties_and_repeats(spark):
    names = ("whole", "threshold", "picks", "rest", "source_size", "target", "copies", "bucket", "power")
    rows = [(i // 3, "a" if i % 4 else None, 7) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n int").select("*", *[F.lit("x").alias(c) for c in names])
    got = mixing.mix(df, F.col("source"), F.col("n"), F.col("doc_id").cast("string")).collect()
    assert len(got) == 300 and got[0]["whole"] == got[0]["picks"] == "x"
    taken = {}
    for r in got:
        taken.setdefault((r["source"], r["doc_id"]), set()).add(r["copies"])
    assert all(len(c) == 1 for c in taken.values())
    for source in ("a", None):
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 21


def test_mix_query(spark):
    rows = mixing.op2_mixing(spark, SF).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = brute.targets(sizes)
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[s]) and mine[0]["source_size"] == sizes[s]
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine) / 2


def shards(spark, rows, n=8):
    df = spark.createDataFrame(rows, "doc_id long, size long, shard string")
    slotted = sharding.slot_records(
        df, F.col("doc_id").cast("string"), F.col("size"), F.concat_ws("|", F.col("doc_id").cast("string"), F.col("size")), n)
    slots = sharding.slot_map(slotted, n)
    return slotted, slots, sharding.place(slotted, slots, ["doc_id", "size"]).collect()


def loads(rows, n=8):
    out = [0] * n
    for r in rows:
        out[r["shard"]] += r["size"]
    return out


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(1)
    _, _, got = shards(spark, [(i, rng.choice([1, 10, 500]), "x") for i in range(3000)])
    assert len(got) == 3000 and max(loads(got)) - min(loads(got)) <= 500
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_hot_key_is_split(spark):
    _, _, got = shards(spark, [(None, 10, "x")] * 2000 + [(i, 10, "x") for i in range(2000)])
    assert len(got) == 4000 and max(loads(got)) <= 1.1 * sum(loads(got)) / 8


def digest(text, modulus):
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16) % modulus


def plain_slots(rows, shards=8):
    """Virtual slot of each (key, size, content); None where equal rows are dealt among slots of their own."""
    total = sum(r[1] for r in rows)
    slots, contents = {}, {}
    for key, size, content in rows:
        slots[digest(key, sharding.SLOTS)] = slots.get(digest(key, sharding.SLOTS), 0) + size
    hot = {s for s, n in slots.items() if n * shards * sharding.HOT_SHARE > total}
    for key, size, content in rows:
        if digest(key, sharding.SLOTS) in hot:
            contents[content] = contents.get(content, 0) + size
    out = []
    for key, _, content in rows:
        slot, piece = digest(key, sharding.SLOTS), digest(content, sharding.PIECES)
        if slot not in hot:
            out.append(slot)
        elif contents[content] * shards * sharding.HOT_SHARE <= total:
            out.append(sharding.SLOTS + slot * sharding.PIECES + piece)
        else:
            out.append(None)
    return out


def plain_map(sizes, shards):
    """Shard of each slot: large ones first, each to the emptiest shard."""
    filled, out = [0] * shards, {}
    for slot, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        least = filled.index(min(filled))
        filled[least] += size
        out[slot] = least
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_slots_and_shards_as_in_plain_python(spark, parts):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2000), rng.choice([1, 10, 500]), "x") for _ in range(2000)]
    rows += [(None, 1 + i % 400, "x") for i in range(1200)] + [(5, 77, "x")] * 1500
    df = spark.createDataFrame(rows, "doc_id long, size long, shard string").repartition(parts)
    content = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")
    slotted = sharding.slot_records(df, F.col("doc_id").cast("string"), F.col("size"), content, 8)
    slots = sharding.slot_map(slotted, 8)
    got = sharding.place(slotted, slots, ["doc_id", "size"]).collect()
    assert len(got) == len(rows)
    text = lambda d: "" if d is None else str(d)
    plain = [(text(r["doc_id"]), r["size"], f"{text(r['doc_id'])}|{r['size']}") for r in got]
    for r, want in zip(got, plain_slots(plain)):
        assert r["virtual_slot"] == want if want is not None else r["virtual_slot"] >= sharding.SLOTS * (1 + sharding.PIECES)
    assert len({r["virtual_slot"] for r in got if r["doc_id"] == 5 and r["size"] == 77}) == sharding.PIECES
    sizes = {}
    for r in got:
        sizes[r["virtual_slot"]] = sizes.get(r["virtual_slot"], 0) + r["size"]
    want = plain_map(sizes, 8)
    assert all(r["shard"] == want[r["virtual_slot"]] for r in got)
    for shard in range(8):
        mine = sorted((r["virtual_slot"], r["slot"]) for r in got if r["shard"] == shard)
        assert [slot for _, slot in mine] == list(range(len(mine)))


def test_map_grows_into_the_new_shard_only(spark, tmp_path):
    _, slots, _ = shards(spark, [(i, 1 + i % 7, "x") for i in range(3000)])
    grown = sharding.grow_map(slots, 8)
    old = {r["slot"]: r["shard"] for r in slots.collect()}
    new = grown.collect()
    assert {r["slot"] for r in new} == set(old) and {r["version"] for r in new} == {2}
    assert all(r["shard"] in (8, old[r["slot"]]) for r in new)
    total, got = sum(r["bytes"] for r in new), sum(r["bytes"] for r in new if r["shard"] == 8)
    assert 0.9 * total / 9 <= got <= total / 9
    sharding.write_map(slots, str(tmp_path / "map"))
    sharding.write_map(grown, str(tmp_path / "map"))
    path = str(tmp_path / "map")
    assert sharding.read_map(spark, path, 1).count() == len(old)
    assert {r["version"] for r in sharding.read_map(spark, path).collect()} == {2}


def test_shards_without_rows(spark):
    assert shards(spark, [])[2] == []


def test_shard_query(spark):
    import zlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = sharding.op8_sharding(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert max(loads(rows)) <= 1.05 * sum(loads(rows)) / 8
    # The edited map moves records into the new shard only.
    assert all(r["next_shard"] in (r["shard"], 8) for r in rows)
    assert sum(r["size"] for r in rows if r["next_shard"] == 8) > 0.8 * sum(loads(rows)) / 9
