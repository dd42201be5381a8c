"""SentencePiece encoding and decoding against the library on whole texts."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from piisieve.llm import pieces
from piisieve.llm.queries import QUERIES
from piisieve.llm.tokens import tokenizer_path

SF_SMALL = "/root/testdata/sf0.001"
PATH = tokenizer_path("piece_bpe_32k.model")
HARD = [None, "", " ", "   a  b ", "a\nb\tc\r\n;\r", "▁a ▁", "<s> </s> <0x0A> <unk>", "a\x00b", "数据获取 一个。", "é́ ñ 😀 ﬁ　x",
        "x" * 3000, " " * 2000 + "a", "数据" * 900, "The the THE.,;'\"()[]{}", "0123456789 3.14", "word " * 20000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_eos=True)
    decoded = library.decode(ids)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(decoded.encode()).hexdigest())


def test_every_document_as_the_library(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op11_sentencepiece"][0](spark, SF_SMALL).collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, d.text) and r.n_corrected == 0


def test_hard_texts_ties_and_other_columns(spark, library):
    rows = [(i % 5 if i else None, t, 7) for i, t in enumerate(HARD + HARD)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    key = lambda r: (r[0] is None, r[0], r[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.report(docs).collect()), key=key)
    assert got == sorted(((i, *expected(library, t)) for i, t, _ in rows), key=key)
    full = pieces.encoded(docs).collect()
    assert {(tuple(r.ids), r.decoded, r.n_corrected) for r in full} == {
        (tuple(ids := library.encode(t or "", add_eos=True)), library.decode(ids), 0) for t in HARD}
    assert pieces.report(docs.where("false")).count() == 0


def test_agenda_alone_gives_the_ids(model, library):
    """The agenda, without the table or the check, on parts that begin with a space."""
    for text in ["internationalization", "aaaaaaaaaaaa", "数据数据x", "éàü", "'s,", "   x"]:
        part = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert model.agenda(part) == library.encode(text)


def test_tables_start_anew(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_PARTS", 3)
    small = pieces.PieceModel(PATH)
    texts = ["one two three four", "five six one", None, "two " * 3]
    for _ in range(3):
        for text, (row, raw, wrong) in zip(texts, small.encode_batch(texts)):
            assert [*map(int, row.split())] == library.encode(text or "") and raw.decode() == (text or "") and not wrong


def test_wrong_results_are_replaced_and_counted(library):
    broken = pieces.PieceModel(PATH)
    broken.agenda = lambda part: [broken.symbol[c] for c in part]      # never joins
    (row, raw, wrong), = broken.encode_batch(["some words"])
    assert [*map(int, row.split())] == library.encode("some words") and raw == b"some words" and wrong == 2


@settings(max_examples=200, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\r\t.,;()the数据é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    model = pieces.piece_model(PATH)
    ids = model.library.encode(text)
    (row, raw, wrong), = model.encode_batch([text])
    assert [*map(int, row.split())] == ids and raw.decode() == model.library.decode(ids) and wrong == 0
