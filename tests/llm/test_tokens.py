import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tessera.llm.packing import CAPACITY, pack, pack_documents
from tessera.llm.pieces import PieceModel, _encoded, encode_documents
from tessera.llm.token_files import TokenFile, TokenFileWriter, read_token_files, write_token_files
from tessera.llm.vocabulary import ChunkEncoder

HARD = ["", " ", "  a  b ", "\x00a\n\tb", "é́ ▁x <s> </s> <unk> <0x41>", "ﬁ　x", "😀x 🤷🏽‍♀️", " lead", "trail ", "a" * 300, "ababab" * 50, "▁▁", "the" * 40 + " " * 37 + "x", "\n\n\n   \n", "日本語 " * 5, "= ==== ------", "it's WE'LL İstanbul ΟΔΟΣ", "a  b", "x<|endoftext|>y", "1234 5 ٣", "foo <|endoftext|> bar", "<|startoftext|><|endoftext|>", "  <|endoftext|>  a\n<|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "<|endoftext|>>"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    alphabet = "abcdeéß日 ▁ \n\t😀.,-=_the ing'"
    return HARD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(1000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, x, "x") for i, x in enumerate(texts[:200])] + [(5, texts[5], "x"), (None, "no id", None), (1000, None, None), (2**62 + 1, "long " * 20_000, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pieces_are_the_librarys(texts):
    path = P.path("piece_bpe_32k.model")
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text, raw in zip(texts, model.encode(texts)):
        want = library.encode(text, add_bos=True, add_eos=True)
        got = [1, *np.frombuffer(raw, "<u4").tolist(), 2]
        assert got == want, text
        assert model.decode(np.array(got)) == library.decode(want), text


def test_pieces_of_broken_bytes():
    path = P.path("piece_bpe_32k.model")
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    for _ in range(200):
        ids = [r.choice([r.randrange(3, 259), r.randrange(259, 32000), 0]) for _ in range(8)]
        assert model.decode(np.array(ids)) == library.decode(ids)


def test_documents_in_pieces(spark, docs):
    got = {r.doc_id: r for r in encode_documents(docs).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for d, text, _ in docs.collect():
        want = library.encode(text or "", add_bos=True, add_eos=True)
        assert got[d].ids == want and got[d].decoded == library.decode(want)
    assert encode_documents(docs.limit(0)).count() == 0
    assert encode_documents(docs).count() == docs.count()


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_chunks_are_the_librarys(texts, name, spaced):
    encoder, library = ChunkEncoder(P.path(name), spaced), Tokenizer.from_file(P.path(name))
    for _ in range(2):
        for text in texts:
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_pack_covers_every_token_once(seed):
    r = np.random.default_rng(seed)
    lengths = r.integers(0, [10, 900, 3000, 9000, 64, 4097][seed], 500)
    pieces = pack(lengths, 2048)
    per_document, per_sequence = {}, {}
    for d, start, n, s, at in pieces:
        assert n > 0
        per_document.setdefault(d, []).append((start, n))
        per_sequence.setdefault(s, []).append((at, n))
    for d, total in enumerate(lengths.tolist()):
        at = 0
        for start, n in sorted(per_document.get(d, [])):
            assert start == at
            at += n
        assert at == total
    for parts in per_sequence.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 2048
    assert len(per_sequence) == -(-int(lengths.sum()) // 2048)


def test_pack_balances_cost():
    lengths = np.array([1000] * 4 + [100] * 40)
    load = np.zeros(4)
    for _, _, n, s, _ in pack(lengths, 2048):
        load[s] += n + n * n / 2048
    assert load.max() < 1.35 * load.min()


def test_pack_cuts_only_what_fits_nowhere():
    lengths = np.random.default_rng(5).lognormal(5.5, 1.0, 2000).astype(np.int64) % 2048
    n = -(-int(lengths.sum()) // 2048)
    assert n > 200
    room, cost, want = np.full(n, 2048), np.zeros(n), {}
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        fits = np.flatnonzero(room >= lengths[d])
        if lengths[d] and len(fits):
            s = int(fits[np.argmin(cost[fits])])
            want[d] = s
            room[s] -= lengths[d]
            cost[s] += 1.0 * int(lengths[d]) + 1.0 / 2048 * int(lengths[d]) ** 2
    got = {d: s for d, _, size, s, _ in pack(lengths, 2048) if size == lengths[d]}
    assert {d: got.get(d) for d in want} == want


def test_packed_documents(spark, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = {d: t or "" for d, t, _ in docs.collect()}
    covered, filled = {}, {}
    for r in pack_documents(docs).collect():
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.length
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered.pop(5) % 2 == 0  # the repeated row
    assert set(covered) == set(texts) - {5}
    for parts in filled.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= CAPACITY
    assert pack_documents(docs.limit(0)).count() == 0


def test_token_files(spark, docs, tmp_path):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = rows(read_token_files(write_token_files(docs, f"file://{tmp_path}")))
    at = 0
    order = sorted(((d, t or "") for d, t, _ in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [g[0] for g in sorted(got, key=lambda g: g[1])] == [d for d, _ in order]
    for (d, text), (_, start, n, crc) in zip(order, sorted(got, key=lambda g: g[1])):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    assert read_token_files(write_token_files(docs.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_file_of_sequences(tmp_path):
    uri = f"file://{tmp_path}/x.arrow"
    writer = TokenFileWriter(uri, "uint16", sequence=8, per_batch=4)
    ids = np.arange(1, 101)
    places = [writer.append(ids[a : a + 7]) for a in range(0, 100, 7)]
    writer.close()
    file = TokenFile(uri)
    assert places == list(range(0, 100, 7)) and len(file) == 13
    assert file[1][0].tolist() == list(range(9, 17)) and all(file[1][1].to_pylist())
    assert file[12][0].tolist() == [97, 98, 99, 100, 0, 0, 0, 0] and file[12][1].to_pylist() == [True] * 4 + [False] * 4
    assert not file[3][0].flags.owndata
    import pyarrow as pa

    before = pa.total_allocated_bytes()
    held = [file[i] for i in range(13)]
    assert pa.total_allocated_bytes() == before and len(held) == 13  # views of the file alone
    assert file.span(5, 60).tolist() == list(range(6, 66))


def test_digests(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    made = lambda ids, text: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
    for d, n, h in rows(_encoded(docs.where("doc_id < 20"), None, "doc_id long, n_tokens long, h string", made)):
        want = library.encode(HARD[d], add_bos=True, add_eos=True)
        assert (n, h) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())


def test_query_of_token_files(spark, docs, monkeypatch):
    import tessera.llm.token_files as S

    monkeypatch.setattr(S, "table", lambda *a: docs)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((d is not None, d or 0, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _ in docs.collect())
    got = rows(S.op7_token_files(spark, ""))
    assert sorted((d is not None, d or 0, n) for d, _, n, _ in got) == want
    at = 0
    for _, start, n, _ in sorted(got, key=lambda g: g[1]):
        assert start == at
        at += n


def test_query_of_pieces(spark, docs, monkeypatch):
    import tessera.llm.pieces as S

    monkeypatch.setattr(S, "table", lambda *a: docs)
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for d, t, _ in docs.collect():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode())))
    assert sorted(rows(S.op4_sentencepiece(spark, "")), key=str) == sorted(want, key=str)


def test_long_text_without_spaces():
    import time

    path = P.path("piece_bpe_32k.model")
    model, library = PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    letters = "".join(r.choice("etaoinshrdlucmfw") for _ in range(200_000))
    for text in (letters[:20_000], "the" * 5_000 + letters[:5_000], "ab" * 10_000, "".join(r.choice("日本語中文字") for _ in range(20_000))):
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library.encode(text), text[:40]
    began = time.perf_counter()
    model.encode([letters])
    assert time.perf_counter() - began < 10
