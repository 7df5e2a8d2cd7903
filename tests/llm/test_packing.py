import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from sleuthgrid.llm.packing import Encoder, _Packer, pack
from sleuthgrid.llm.shared import tokenizer_path

from .brute import DOCS, corpus

PATH = tokenizer_path("byte_bpe_50k.json")


def test_ids_as_the_tokenizer_gives_them():
    encoder, tokenizer = Encoder(PATH), Tokenizer.from_file(PATH)
    assert encoder.fast is not None
    for text in [*(r[1] or "" for r in corpus()), "a<|endoftext|>b", "x" * 9000, " " * 900 + "a", "it's  we'll\t\r\n 12٣½ é́   \x85 👩‍👩‍👧 "]:
        assert encoder.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert Encoder(tokenizer_path("word_bpe_49k.json")).fast is None


@pytest.mark.parametrize(("size", "open_windows", "parts"), [(64, 4, 3), (1024, 64, 2), (16, 2, 5)])
def test_round_trip(spark, size, open_windows, parts):
    rows = [*corpus(), (None, "null id", None, None, 1), (3, "again the third", None, None, 1)]
    out = pack(spark.createDataFrame(rows, DOCS).repartition(parts), PATH, size=size, open_windows=open_windows, keep_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted(((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0])) for r in rows), key=str)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] > 0 and zlib.crc32(r["ids"]) == r["ids_crc32"]
        docs[r["doc_id"], r["doc_tokens"]].append((r["start"], ids.tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    got = []
    for (doc_id, total), pieces in docs.items():
        whole = [x for _, ids in sorted(pieces) for x in ids]
        assert len(whole) == total
        got.append((doc_id, tuple(whole)))
    assert sorted(got, key=str) == want
    short = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
        short += at < size
    assert short <= 10


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").selectExpr("*", "1 as start", "2 as ids", "3 as bundle")
    assert pack(df.limit(0), PATH).collect() == []
    assert pack(df, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def brute_pack(lengths, size, most):
    """Best fit by looking at every open window: (windows in the order they go out, those still open), a piece is (document, start, length)."""
    free, pieces, out, made = {}, {}, [], 0
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= size:
            out.append([(doc, at, size)])
            at += size
        if n == at:
            continue
        fits = [w for w in free if free[w] >= n - at]
        if fits:
            w = min(fits, key=lambda w: (free[w], w))
            pieces[w].append((doc, at, n - at))
            free[w] -= n - at
            if not free[w]:
                out.append(pieces.pop(w))
                del free[w]
            continue
        if len(free) == most:
            w = min(free, key=lambda w: (free[w], w))
            step = free.pop(w)
            out.append([*pieces.pop(w), (doc, at, step)])
            at += step
        free[made], pieces[made] = size - (n - at), [(doc, at, n - at)]
        made += 1
    return out, list(pieces.values())


@pytest.mark.parametrize(("size", "most"), [(16, 1), (16, 3), (64, 8), (1024, 64)])
def test_best_fit_as_brute_force(size, most):
    rng = random.Random(size)
    lengths = [min(3 * size, max(1, int(rng.expovariate(2 / size)))) for _ in range(1500)]
    packer, out = _Packer(size, most), []
    plain = lambda window: [(doc, start, len(ids) // 4) for doc, start, ids, _ in window]
    for doc, n in enumerate(lengths):
        out += [plain(w) for w in packer.add(doc, bytes(4 * n))]
        assert len(packer.windows) <= most
    want, left = brute_pack(lengths, size, most)
    assert out == want and [plain(w) for w in packer.windows.values()] == left


def test_ids_of_all_characters_as_the_tokenizer_gives_them():
    encoder, tokenizer = Encoder(PATH), Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(1, 0x20000) if not 0xD800 <= c < 0xE000]
    for form in ("{}", " {}a", "a{} b", "{0}{0} "):
        for lo in range(0, len(letters), 4096):
            text = "x".join(form.format(c) for c in letters[lo : lo + 4096])
            assert encoder.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
