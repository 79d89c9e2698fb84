import codecs
import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from strideline.llm import bpe, ids, pieces
from strideline.llm.entry import vocabulary

PATH, LIBRARY = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  a  b ", "a \n b\n\n c", "don't I'll we've 's 't 'sx 're'a", "naïve 日本語 текст 🎉🎉", "a" * 3000, "<|endoftext|>", "x y    z \t\tq", "½ ²³ १२३ Ⅷ", "\x1c y\x85z　 q", "''s x'", "\n's\n"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pieces.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_encode_equals_the_library_on_odd_texts(reference):
    got = list(bpe.codec(PATH).encode(ODD))
    assert [x.tolist() for x in got] == [reference.encode_ordinary(t) for t in ODD]
    assert ["".join(bpe.codec(PATH).decode(x.tolist())) for x in got] == ODD


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="ab's'tre vl d\n\t ,.1é", max_size=60), st.text(alphabet=st.characters(codec="utf-8"), max_size=40)), max_size=6))
def test_encode_equals_both_libraries(texts):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=pieces.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}) if not hasattr(test_encode_equals_both_libraries, "enc") else test_encode_equals_both_libraries.enc
    test_encode_equals_both_libraries.enc = enc
    assert [x.tolist() for x in bpe.codec(PATH).encode(texts)] == [enc.encode_ordinary(t) for t in texts]
    e = ids.encoder(LIBRARY)
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.library.encode_batch(texts, add_special_tokens=False)]


def test_small_tables_and_long_texts(reference, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH", 50)
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    c = bpe.Codec(PATH)
    c.memo.entries = 10
    texts = ["Some words, and more words. " * 40, "x" * 500, *ODD]
    assert [x.tolist() for x in c.encode(texts)] == [reference.encode_ordinary(t) for t in texts]


def test_pair_check_equals_bpe(reference):
    fst = bpe.codec(PATH).fst
    for a in range(0, 3000, 37):
        for b in range(11, 3000, 41):
            whole = fst.token[a] + fst.token[b]
            assert fst.keeps_apart(a, b) == (reference._core_bpe.encode_single_piece(whole) == [a, b])


@given(st.binary(max_size=40), st.lists(st.integers(1, 5), max_size=40))
def test_utf8_machine_equals_the_incremental_decoder(data, steps):
    m, at, out = bpe.Utf8Machine(), 0, ""
    for n in [*steps, len(data)]:
        out += m.feed(data[at : at + n])
        at += n
    assert out + m.close() == codecs.decode(data, "utf-8", "replace")


def test_table(docs, by_id, reference):
    texts = [None, *ODD]
    got = by_id(bpe.round_trip(docs(texts), PATH))
    for i, t in enumerate(texts):
        want = reference.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = by_id(bpe.decode(bpe.encode(docs(texts), PATH), PATH))
    assert [back[i]["text"] for i in range(len(texts))] == [t or "" for t in texts]
    assert bpe.round_trip(docs([]), PATH).count() == 0
