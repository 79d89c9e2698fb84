import io
import zlib

import numpy as np
import pytest

from strideline.llm import idfile, ids
from strideline.llm.common import new_path
from strideline.llm.entry import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    v = np.random.default_rng(n).integers(0, 50_000, n).astype(ids.ID)
    planes = idfile.to_planes(v, bits)
    assert len(planes) == (32 if bits else 4)
    assert (idfile.from_planes(planes, n, v.dtype, bits) == v).all()


@pytest.mark.parametrize("bits", [False, True])
def test_file_round_trip(bits, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK", 100)
    rng, out = np.random.default_rng(0), io.BytesIO()
    docs = [(d, rng.integers(0, 60_000, n).astype(ids.ID)) for d, n in [(None, 3), (-5, 1), (2, 0), (3, 250), (3, 99), (2**40, 1000)]]
    w = idfile.Writer(out, bits)
    for d, x in docs:
        w.add(d, x)
    w.close()
    data = out.getvalue()
    r = idfile.Reader(io.BytesIO(data), len(data))
    assert len(r) == 14 and (r.ids(3) == np.concatenate([x for _, x in docs])[300:400]).all()
    for (d, n, parts), (want, x) in zip(r.pieces(), docs, strict=True):
        assert d == want and n == len(x) and (np.concatenate([*parts, np.zeros(0, ids.ID)]) == x).all()
    with pytest.raises(ValueError):
        idfile.Reader(io.BytesIO(b"x" * 100), 100)


def test_stored_table(docs):
    texts = [f"text {i} " * (i % 50) for i in range(200)] + [None, "", "last"]
    order = [*range(400, 200, -1), 7, 7, 9]
    rows = sorted(((i, t or "") for i, t in zip(order, texts)))
    made = [np.concatenate([x, [2]]).astype(ids.ID) for x in ids.encoder(PATH).encode([t for _, t in rows])]
    start, want = 0, []
    for (i, _), x in zip(rows, made):
        want.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    got = idfile.stored(docs(texts, ids=order), PATH)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(want)
    assert idfile.stored(docs([]), PATH).count() == 0


def test_bit_planes_on_disk(spark, docs):
    folder = new_path(spark, "bits")
    df = docs(["some words here"] * 20)
    bits = idfile.read_ids(idfile.write_ids(df, folder, PATH, bits=True), folder).orderBy("start").collect()
    assert bits == idfile.stored(df, PATH).orderBy("start").collect()
