"""Byte-level BPE against the tiktoken library, alignment of two tokenizers against plain Python."""

import bisect
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from quarry.llm import byte_bpe, queries, token_alignment

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGE = [None, "", " ", "a", "\n\n  \t x", "ß日本語 'll don't 12 ½", "<|endoftext|>", "\x00\x1c\x85 é", "🦜" * 40, "word " * 5000]


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def merger():
    return byte_bpe.Merger(RANKS, public_tokenizers.PATTERN)


def same(merger, coder, texts):
    ids, n = merger.encode(texts)
    for text, own, raw in zip(texts, np.split(ids, np.cumsum(n)[:-1]), merger.decode(ids, n), strict=True):
        assert own.tolist() == coder.encode_ordinary(text)
        assert raw == text.encode()


def test_query(spark, coder):
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_byte_bpe(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        ids = coder.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()


def test_edges_and_clashing_names(spark, coder):
    rows = [(k % 4 or None, t, "z") for k, t in enumerate(EDGE * 2)]
    d = spark.createDataFrame(rows, "k long, t string, ids string").withColumn("decoded", F.lit(1)).withColumn("start", F.lit(2))
    got = byte_bpe.bpe_encode(d, RANKS, public_tokenizers.PATTERN, key="k", text="t").collect()
    as_row = lambda k, ids, raw: (k or 0, np.array(ids, "<u4").tobytes(), raw)
    assert sorted(as_row(r.k, np.frombuffer(r.ids, "<u4"), bytes(r.decoded)) for r in got) == sorted(as_row(k, coder.encode_ordinary(t or ""), (t or "").encode()) for k, t, _ in rows)
    with pytest.raises(ValueError):
        byte_bpe.bpe_encode(d, RANKS, public_tokenizers.PATTERN, key="IDS", text="t")
    assert byte_bpe.bpe_encode(d.limit(0), RANKS, public_tokenizers.PATTERN, key="k", text="t").count() == 0


def test_every_character(merger, coder):
    same(merger, coder, [f"a{c}b 1{c}2 {c}{c}. {c} {c}\n" for c in map(chr, [*range(0, 0x3000), *range(0xE000, 0xF000), *range(0x1F300, 0x1F400)])])


@pytest.mark.parametrize("size", [63, 66, 300, 5000])
def test_long_words(merger, coder, size):
    r = random.Random(size)
    kinds = ["acgt", "ab", "abcdefghijklmnopqrstuvwxyz", "аеиоуклмнпрст日本語中文", "aeiou"]
    same(merger, coder, ["".join(r.choice(k) for _ in range(size)) for k in kinds] + ["a" * size, "xy" + "ab" * size, " " * size, "=-" * size, "x" + "aab" * size + "c" + "a" * size])


def test_small_bounds(coder, monkeypatch):
    """Portions, forgetting and restarts of the recursion change nothing."""
    for name, value in {"REMEMBER": 50, "PORTION_WORDS": 7, "PORTION_CHARS": 40, "QUERY_BYTES": 30, "QUERY_IDS": 9, "SHORT": 8, "WINDOW": 1}.items():
        monkeypatch.setattr(byte_bpe, name, value)
    m = byte_bpe.Merger(RANKS, public_tokenizers.PATTERN)
    r = random.Random(5)
    same(m, coder, [" ".join("".join(r.choice("aeinrst") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 30))) for _ in range(40)] + ["aab" * 60, "na" * 300])


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  two  spaces \n new", "a", "x ▁ y", "▁", "<s> </s> <unk> <|endoftext|> <0x41>", "tab\tand é́ ½ ﬁ 日本語 🦜", "  　 a ̈b", " lead and trail ", "a\x00b \x1c c", "word " * 3000, "q" * 3000]


def plain_alignment(rows, whole_groups=False):
    """Digest rows by loops over tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    of, extra = {}, 256
    for x in range(256):
        if x in printable:
            of[chr(x)] = x
        else:
            of[chr(extra)] = x
            extra += 1

    def pieces(text):
        a = [(i, bytes(of[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()) for i in tb.encode(text)]
        want = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])

    def ends(side):
        at, out = 0, []
        for i, x in side:
            at += len(x)
            out.append((i, at))
        return out

    found, counts = [], {}
    for k, text in rows:
        a, b = map(ends, pieces(text) if text else ([], []))
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups = [([], []) for _ in cuts]
        for side, tokens in enumerate((a, b)):
            for i, e in tokens:
                groups[bisect.bisect_left(cuts, e)][side].append(i)
        links = [(i, j) for x, y in groups for i in x for j in y] if whole_groups else [(x[-1], y[-1]) for x, y in groups]
        for p in links:
            counts[p] = counts.get(p, 0) + 1
        found.append((k, a, b, groups, links))
    most = {}
    for (_, j), n in counts.items():
        most[j] = max(most.get(j, 0), n)
    write = lambda g: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
    return sorted((k or 0, len(a), len(b), len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(write(g).encode()).hexdigest() if a else "") for k, a, b, g, x in found)


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def digest(rows, key="doc_id"):
    return sorted((r[key] or 0, *(r[c] for c in NAMES)) for r in rows)


def some_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 4000").orderBy("doc_id").limit(80).collect()
    return [(r.doc_id, r.text) for r in docs] + [(9000 + k, t) for k, t in enumerate(ODD)] + [(9001, "x"), (None, "one two"), (None, None)]


@pytest.mark.parametrize("bounds", [{}, {"REMEMBER": 30, "PORTION": 60, "COUNT_AT_ONCE": 20, "HOLD": 10, "LOOKUP": 300}, {"LOOKUP": 1}])
@pytest.mark.parametrize("whole_groups", [False, True])
def test_alignment(spark, monkeypatch, bounds, whole_groups):
    for name, value in bounds.items():
        monkeypatch.setattr(token_alignment, name, value)
    rows = some_rows(spark)
    d = spark.createDataFrame(rows, "id long, text string").withColumn("links", F.lit(1)).withColumn("K", F.lit("x")).withColumn("_row", F.lit(3)).repartition(5)
    got = token_alignment.Alignment(d, A, B, key="id", whole_groups=whole_groups).scored().collect()
    assert digest(got, "id") == plain_alignment(rows, whole_groups)


def test_alignment_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if not r.text or len(r.text) < 30000]
    assert len(rows) == 200
    assert digest(queries.op12_token_alignment(spark, SF).collect()) == plain_alignment(rows)


def test_alignment_of_whole_texts(spark, monkeypatch):
    """A side that may join what a space separates gets whole texts; groups are the operator's own column."""
    one = token_alignment.Aligner(A, B, False)
    one.by_space = False
    two = token_alignment.Aligner(A, B, False)
    texts = [t for _, t in some_rows(spark)]
    x, y = one.rows(texts), two.rows(texts)
    assert x["groups"] == y["groups"] and x["links"] == y["links"] and all((x[c] == y[c]).all() for c in ("n_a", "n_b", "n_groups"))
    with pytest.raises(ValueError):
        token_alignment.Alignment(spark.createDataFrame([], "LINKS long, text string"), A, B, key="LINKS")
