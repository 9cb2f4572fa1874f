"""Alignment of two tokenizations against the libraries and plain Python."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from meshframe.llm import alignment
from meshframe.llm.common import pin

SF = "/root/testdata/sf0.001"
PATH_A, PATH_B = public_tokenizers.path(alignment.MODEL_A), public_tokenizers.path(alignment.MODEL_B)
TEXTS = [
    None, "", " ", "a", "two words", "  spaced   out  ", "a▁b", "<s> <|endoftext|>", "é日本 😀", "\n\ttab\r\n", "it's 12345 ½ Ⅷ", "x\x1cy\x85z",
    "\x00", "word " * 2000, "unbroken" * 3000, "the cat. the cat. the cat.",
]


class Plain:
    """The contract, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.byte = {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}

    def tokens(self, text):
        if not text:
            return [], []
        spaced = " " + text
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(spaced, add_special_tokens=False).ids]
        b = [(i, bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode())
             for i in self.b.encode(text)]
        if any(b"".join(x for _, x in side) != spaced.encode() for side in (a, b)):
            return [], []
        return a, b

    def document(self, text):
        a, b = self.tokens(text)
        ends = [{}, {}]
        for side, tokens in zip(ends, (a, b)):
            at = 0
            for k, (_, raw) in enumerate(tokens):
                at += len(raw)
                side[at] = k
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links, groups, last = [], [], (0, 0)
        for cut in cuts:
            i, j = ends[0][cut], ends[1][cut]
            links.append((a[i][0], b[j][0]))
            groups.append(",".join(str(t) for t, _ in a[last[0]:i + 1]) + "|" + ",".join(str(t) for t, _ in b[last[1]:j + 1]))
            last = (i + 1, j + 1)
        return len(a), len(b), len(cuts), links, ";".join(groups)

    def corpus(self, texts):
        docs = [self.document(t) for t in texts]
        counts = Counter(link for d in docs for link in d[3])
        top = {}
        for (_, b), n in counts.items():
            top[b] = max(top.get(b, 0), n)
        return [(a, b, g, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
                 hashlib.sha256(groups.encode()).hexdigest() if a else "") for a, b, g, links, groups in docs]


@pytest.fixture(scope="module")
def plain():
    return Plain()


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abc the   ing é😀\n\tß#<s>ωΣ日tion0x41'") for _ in range(rng.randint(1, 200))) for _ in range(n)]


def test_lockstep_finds_all_common_ends():
    rng = np.random.default_rng(1)
    for total in (0, 1, 7, 5000):
        a, b = (np.unique(np.append(rng.integers(1, total + 1, total // k), total)) if total else np.empty(0, np.int64) for k in (2, 3))
        for step in (1, 3, 64, 10**6):
            bounds = np.unique(np.append(np.arange(0, total + 1, step), total))
            x, y = alignment.lockstep(a, b, bounds)
            want = np.intersect1d(a, b)
            assert (a[x] == want).all() and (b[y] == want).all() and len(x) == len(want)


def test_documents_with_nulls_repeats_and_clashing_columns(spark, plain, monkeypatch):
    texts = TEXTS + noise(200, 1)
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(i, t, "x", "y") for i, t in enumerate(texts[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string, slice string, links string")
    aligned = alignment.align(df, PATH_A, PATH_B)
    got = {}
    for r in aligned.where("codes is null").collect():
        a, b, g, links, groups = plain.document(texts[r["row"]["doc_id"]])
        assert (r["n_a"], r["n_b"], r["n_groups"], r["groups"]) == (a, b, g, groups)
        assert r["row"]["slice"] == "x"
        got[r["row"]["doc_id"]] = r
    assert len(got) == len(texts)
    out = alignment.link_figures(pin(aligned), 32000).collect()
    want = plain.corpus([t for _, t, _, _ in rows])
    assert sorted((r["row"]["doc_id"], r["n_best"], r["count_sum"]) for r in out) == sorted(
        (rows[i][0], w[4], w[5]) for i, w in enumerate(want))


def test_small_slices_count_alike(spark, plain, monkeypatch):
    monkeypatch.setattr(alignment, "_CHUNK_BYTES", 50)
    texts = noise(60, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    whole = alignment.link_figures(pin(alignment.align(df, PATH_A, PATH_B)), 32000).collect()
    monkeypatch.setattr(alignment, "SLICE_LINKS", 10)
    cut = alignment.link_figures(pin(alignment.align(df, PATH_A, PATH_B)), 32000).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, cut))


def test_query_on_given_documents(spark, plain):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: w for (d, _), w in zip(docs, plain.corpus([t for _, t in docs]))}
    rows = alignment.op13_alignment(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r)[1:] == want[r["doc_id"]]


def vocabularies():
    with open(PATH_A, "rb") as f, open(PATH_B, "rb") as g:
        return alignment.pair(f.read(), g.read())


def test_a_megabyte_of_text_is_cut_into_lanes(plain):
    rng = random.Random(5)
    for text in ("".join(rng.choice(["the ", "cation", "é", "日本", "xyz, ", "\n"]) for _ in range(300_000)),
                 "".join(rng.choice("abcdeinrst") for _ in range(1_000_000)), " " * 200_000 + "x"):
        both = vocabularies()
        left, right = both.encode(text)
        size = len(text.encode()) + 1
        x, y = alignment.lockstep(np.cumsum(both.sizes[0][left]), np.cumsum(both.sizes[1][right]), alignment.lanes(np.array([size])))
        want = plain.document(text)
        assert (len(left), len(right), list(zip(left[x].tolist(), right[y].tolist()))) == (want[0], want[1], want[3])


def test_unfit_vocabularies_are_refused():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        with pytest.raises((ValueError, KeyError)):
            alignment.ByteVocabulary(f.read())
    with open(PATH_A, "rb") as f:
        spec = json.loads(f.read())
    spec["model"]["merges"].reverse()
    with pytest.raises(ValueError):
        alignment.ByteVocabulary(json.dumps(spec).encode())


def test_no_rows(spark):
    df = spark.createDataFrame([], "text string, doc_id long")
    assert alignment.link_figures(pin(alignment.align(df, PATH_A, PATH_B)), 32000).collect() == []
