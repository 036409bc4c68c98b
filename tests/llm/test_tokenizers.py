import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import bpe, pieces

ODD = ["", " ", "   ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\n\n  a \t", "你好 world 😀😀", "ａ​b  \t x ▁▁ y▁z", "a" * 3000, "  " * 50, "é́ÀÉ", "<s> hi </s><unk>\x00\x01", "foo\r\nbar", "don't we'll I'd", "x" * 200 + " " + "ab" * 500, "�"]


@pytest.fixture(scope="module")
def texts():
    own = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()[:300]
    r = random.Random(2)
    return own + ODD + ["".join(r.choice("ab▁ \n'é😀0.<|>the") for _ in range(r.randrange(60))) for _ in range(400)]


def test_token_counts(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counts, library = bpe.Counts.from_file(path), Tokenizer.from_file(path)
    assert [counts.text(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_count_rows(spark):
    counts = bpe.Counts.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([(1, "hello world", "x"), (None, None, "y"), (2, "", None), (2, "é " * 2000, None)], "doc_id long, text string, id string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.token_counts(df, counts).collect()), key=str)
    want = [(i, len((t or "").encode()), n := counts.text(t or ""), n > 1024) for i, t, _ in [tuple(r) for r in df.collect()]]
    assert got == sorted(want, key=str)
    assert bpe.token_counts(df.limit(0), counts).collect() == []


def test_pieces_match_the_library(texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, library = pieces.Model.from_file(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [model.encode(t) for t in texts]
    assert ids == library.encode(texts)
    assert [model.decode(i) for i in ids] == library.decode(ids)
    r = random.Random(1)
    odd = [[r.randrange(len(model.pieces)) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(6)] for _ in range(200)]
    assert [model.decode(i) for i in odd] == [library.decode(i) for i in odd]


def test_pieces_rows(spark):
    model = pieces.Model.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([(1, "hello  world\n", "x"), (None, None, "y"), (2, "", None), (2, "é " * 2000, None)], "doc_id long, text string, id string")
    out = pieces.encoded(df, model)
    assert all(r.round_trip for r in out.collect())
    assert sorted(str(r.text) for r in pieces.decoded(out, model).collect()) == sorted((t or "") for _, t, _ in [tuple(r) for r in df.collect()])
    assert {r.n_pieces for r in pieces.report(df, model).where("doc_id = 1").collect()} == {len(model.encode("hello  world\n"))}
    assert pieces.report(df.limit(0), model).collect() == []


def best(text, scores, floor):
    """The best segmentation by trying all."""
    out = {0: (0.0, [])}
    for i in range(1, len(text) + 1):
        found = [(out[j][0] + scores[text[j:i]], out[j][1] + [text[j:i]]) for j in range(i) if text[j:i] in scores]
        if text[i - 1] not in scores:
            found.append((out[i - 1][0] + floor, out[i - 1][1] + [text[i - 1]]))
        out[i] = max(found, key=lambda x: x[0])
    return out[len(text)]


def test_unigram_viterbi():
    r = random.Random(4)
    vocabulary = [("<unk>", 0.0, pieces.UNKNOWN)] + [(c, -r.uniform(5, 9), pieces.NORMAL) for c in "abc▁"]
    vocabulary += [(p, -r.uniform(2, 9), pieces.NORMAL) for p in sorted({"▁" * r.randrange(2) + "".join(r.choice("abc") for _ in range(r.randrange(2, 5))) for _ in range(40)})]
    model = pieces.Model(vocabulary, pieces.UNIGRAM)
    scores = {p: s for p, s, t in vocabulary if t == pieces.NORMAL}
    for _ in range(300):
        text = "".join(r.choice("abcabcabcd ") for _ in range(r.randrange(25)))
        want = best(model.normalize(text), scores, model.floor)
        got = [p for w in model.split(model.normalize(text)) for p in model.segment(w)]
        assert sum(scores.get(p, model.floor) for p in got) == pytest.approx(want[0])
        assert "".join(got) == model.normalize(text)


def test_bounded_tables():
    from foliant.llm.words import Remembered

    m = Remembered(10)
    for k in range(1000):
        m.put(k, k)
        assert m.get(k) == k and len(m.young) + len(m.old) <= 10
