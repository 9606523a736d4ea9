
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rangeloom.llm import pretokens, tokens

JSON = f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


ODD = [
    "", " ", "  ", "\n", " \n a", "a  b", "a\n\nb", "don't can'T we're I'll 've '", "''s 's's 'sam x'd'", " 's", "'re're'r", "'l'll", "a' s", "<|endoftext|> x", "1234 5,6.7e-8 ½²", "été İß ǅ",
    "日本語テキスト 한국어", "👩‍👩‍👧‍👦🏽 ‍️", "  x　 y", "​\u0085 z", "áë ำ", "\t\t x\r\n\r\n", "x" * 5000, " " * 3000 + "a", "퟿\U0010ffff", "\x00\x01", "ﬀ９Ⅳ①", "𝒜𝟘 \U0001e900",
]


def splits(texts, classes):
    import pyarrow as pa

    b = pretokens.Block(pa.array(texts))
    at = list(pretokens.starts(b, classes)) + [len(b.cp)]
    whole = "".join(x or "" for x in texts)
    return [whole[a:b] for a, b in zip(at[:-1], at[1:])]


def test_pretokens(library):
    classes = pretokens.class_table(pretokens.char_classes(JSON))
    every = ["a" + chr(c) + "1" + chr(c) + " " + chr(c) + "\n" for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF]
    for texts in (ODD, ["", None, "a b", "", " c"], every):
        want = [t[a:b] for t in texts if t for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]
        assert splits(texts, classes) == want


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'srevmldt1a.é")), max_size=40), max_size=5))
def test_pretokens_random(library, texts):
    classes = pretokens.class_table(pretokens.char_classes(JSON))
    assert splits(texts, classes) == [t[a:b] for t in texts if t for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]


def test_encode_and_decode(spark, library):
    texts = ODD + [None, "word " * 400_000, "same", "same", "same"]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)] + [(None, "null key", 1, "y")], "doc_id bigint, text string, block int, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    want = {i: e.ids for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False))}
    assert got == want | {None: library.encode("null key").ids}
    n = {r["doc_id"]: r["n_tokens"] for r in tokens.counts(df).collect()}
    assert n == {k: len(v) for k, v in got.items()}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df.where("doc_id is not null"))).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0)).collect() == []


def test_loss_tokens(spark, library):
    texts = ["A: b\nC: d\n\nbody text here", "no header at all", "A: b\r\n\r\nbody\n\nmore", "\n\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["loss_tokens"]) for r in tokens.counts(df).collect()}
    assert got[1][0] == got[1][1] and got[4] == (0, 0) and got[3][1] == 0
    assert 0 < got[0][1] < got[0][0] and got[0][1] == len(library.encode("body text here").ids)


def test_bytes_that_are_not_utf8(spark):
    df = spark.sql("select 1L as doc_id, cast(unhex('61ff62') as string) as text union all select 2L, 'a�b'")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got[1] == got[2]


def test_all_documents(spark, data, library):
    from rangeloom.tables import table

    docs = table(spark, data, "documents")
    rows = docs.select("doc_id", "text").collect()
    want = {r["doc_id"]: e.ids for r, e in zip(rows, library.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False))}
    assert {r["doc_id"]: r["ids"] for r in tokens.encode(docs).collect()} == want


def test_decode_odd_lists(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [0, 1]), (4, [50255]), (5, [94])], "doc_id bigint, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in tokens.decode(df).collect()}
    assert got[1] == got[2] == "" and got[3] == '!"' and got[5] is None and len(got) == 5
