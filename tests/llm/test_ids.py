import random
import zlib

import numpy as np
import pytest

from strideline.llm import idfile, ids, packing, pieces
from strideline.llm.entry import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
END = "<|endoftext|>"
TEXTS = [f"end {END} next", END, END * 3, f" {END}\n {END}'s", f"a{END[:-1]}{END}", "no mark here", "", f"é {END}é"]


@pytest.fixture(scope="module")
def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("batch", [20, 1 << 19])
def test_added_tokens_as_the_library_gives_them(fresh, batch, monkeypatch):
    monkeypatch.setattr(pieces, "BATCH", batch)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choices([END, END[:5], END[5:], " ", "  ", "\n", "word", "'s", "é", "a b. "], k=rng.randint(0, 12))) for _ in range(500)]
    assert [x.tolist() for x in ids.Encoder(PATH).encode(texts)] == [x.ids for x in fresh.encode_batch(texts, add_special_tokens=False)]


def test_tables_with_added_tokens(docs, fresh):
    made = [np.array([*fresh.encode(t, add_special_tokens=False).ids, 2], ids.ID) for t in TEXTS]
    got = idfile.stored(docs(TEXTS), PATH).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["ids_crc32"]) for r in got] == [(len(x), zlib.crc32(x.tobytes())) for x in made]
    length = dict.fromkeys(range(len(TEXTS)), 0)
    for r in packing.pack(docs(TEXTS), PATH).collect():
        length[r["doc_id"]] += r["length"]
    assert list(length.values()) == [len(x) for x in made]
