import io
import random
import struct
import zlib

import pytest
from cartolith.llm import packing, token_files, tokens

DOCS = "doc_id bigint, text string, start string, ids int"


def plain(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def sample():
    r = random.Random(9)
    odd = ["", None, "   ", "a  b   c\n\n d\t\te ", "it's <|endoftext|> we'LL", "ñandú éàü ß", "日本語 テキスト", "🙂🙂 x", "​ q\u0085z", "x" * 5000, "1234567 12,5", "Ǆ ʼn \x1f \x00", "naïve café—ok", "‘q’ “r”…"]
    many = [" ".join(r.choice(["the", "Thing,", "onan", "\n", "12", "être"]) for _ in range(r.randint(1, 900))) for _ in range(60)]
    return odd + many


def test_encoder_equals_the_library(monkeypatch):
    import numpy as np

    texts = [x or "" for x in sample()] + ["a\n b", "a \nb", "a  b", "a   b ", " \n ", "a\n\u00a0b", "a \u00a0 b", "x\t y\r\n  z ", "£ ©x «a» ¿q?", "Ӏ Ԯ ԰", "\ufeffa b", "ﬁ x", "don't (it'll) a'\nb,\nC.\n\nD\t\te- f--g x,'y z's\n's [a]b{c} é,ü.\né a1b2,3c"]
    raw = [x.encode() for x in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    want = [x[:-1] for x in plain(texts, 0)]

    def rows(enc):
        ids, cut = enc.encode(data, off)
        return [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]

    enc = tokens.Encoder(tokens.default_path())
    for _ in range(2):
        assert rows(enc) == want
    assert enc.cuts
    enc.cuts = False
    assert rows(enc) == want
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    assert rows(tokens.Encoder(tokens.default_path())) == want


def test_added_tokens_and_other_files():
    """The plain call decides: an added token's string is its id, and a file with
    another pre-tokenizer is never cut."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["hello <|endoftext|> x", "a<|endoftext|>b the end", "<|endoftext|>", "<|endoftext", "the end of it", "A Text, it's 12 o'clock <|endoftext|>", "", "naïve   x"] * 2
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate(([0], np.cumsum([len(x.encode()) for x in texts])))
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        enc, library = tokens.Encoder(path), Tokenizer.from_file(path)
        ids, cut = enc.encode(data, off)
        assert [ids[a:b].tolist() for a, b in zip(cut, cut[1:])] == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert not enc.cuts and 50256 in Tokenizer.from_file(tokens.default_path()).encode(texts[0], add_special_tokens=False).ids


def test_very_long_texts(spark):
    long = "the onan, " * 300_000
    rows = packing.pack(frame(spark, [long, "日" * 200_000, "x"])).collect()
    want = plain([long, "日" * 200_000, "x"], packing.END_ID)
    assert {r.doc_id: r.doc_tokens for r in rows} == {i * 3: len(x) for i, x in enumerate(want)}
    assert sum(r.length for r in rows) == sum(map(len, want))


def frame(spark, texts, ids=None):
    ids = ids or [i * 3 for i in range(len(texts))]
    return spark.createDataFrame([(d, t, "s", 1) for d, t in zip(ids, texts)], DOCS).repartition(3)


def test_packing(spark):
    texts = sample()
    pieces = packing.pack(frame(spark, texts), with_ids=True)
    rows = pieces.collect()
    want = {i * 3: x for i, x in enumerate(plain(texts, packing.END_ID))}
    by_doc, by_seq = {}, {}
    for r in rows:
        ids = [i[0] for i in struct.iter_unpack("<I", r.ids)]
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, ids))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {d: sum((x for _, x in sorted(v)), []) for d, v in by_doc.items()} == want
    full = sum(map(len, want.values()))
    assert sorted(by_seq) == list(range(-(-full // packing.LENGTH)))
    for seq, v in by_seq.items():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at == packing.LENGTH or seq == max(by_seq)
    made = packing.windows(pieces).collect()
    assert all(len(r.ids) == 4 * packing.LENGTH or r.n_tokens.bit_count() == 1 for r in made)
    assert packing.pack(frame(spark, ["x"]).limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = frame(spark, ["a b", "a b", None], [5, 5, None])
    assert sorted((str(r.doc_id), r.length) for r in packing.pack(df).collect()) == [("5", 3), ("5", 3), ("None", 1)]


def test_token_files(spark, tmp_path):
    texts = sample()
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write(frame(spark, texts, [100 - i for i in range(len(texts))]), folder)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read(spark, folder, manifest).collect())
    want, start = [], 0
    for doc_id, ids in sorted(zip([100 - i for i in range(len(texts))], plain(texts, 0))):
        raw = struct.pack(f"<{len(ids)}I", *ids)
        want.append((doc_id, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    assert got == want
    empty = token_files.write(frame(spark, ["x"]).limit(0), folder + "-none")
    assert token_files.read(spark, folder + "-none", empty).count() == 0


def test_reader_opens_only_the_frames_it_needs():
    r = random.Random(2)
    docs = [r.randbytes(4 * r.randint(1, 400)) for _ in range(200)]
    out = io.BytesIO()
    w = token_files.Writer(out, frame_bytes=2000)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    w.close()
    raw = bytearray(out.getvalue())
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    assert [b for _, _, b in reader.documents()] == docs and len(reader.frames) > 20
    assert reader.read(77) == [docs[77]] and reader.read(5000) == []
    last = len(reader.frames) - 2
    raw[reader.begins[last] + reader.frames[last][0] - 1] ^= 1  # damage the last frame
    reader = token_files.Reader(io.BytesIO(raw), len(raw))
    assert reader.read(1) == [docs[1]]
    with pytest.raises(Exception):
        reader.read(199)
    assert token_files.round_trip(docs) == docs
