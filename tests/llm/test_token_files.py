import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
from tokenizers import Tokenizer

from delayrisk.llm import token_files as T
from delayrisk.llm.common import scratch
from delayrisk.llm.queries import op4_token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


def expected(rows):
    """Documents in ascending id order (nulls first), with the end id."""
    t = Tokenizer.from_file(PATH)
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_matches_the_library(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_token_orc(spark, SF).collect()
    assert sorted(map(tuple, got)) == expected(rows)


def test_files_ascend_and_ids_are_pushed_down(spark):
    folder = scratch(spark, "test-tokens")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    T.write(docs, folder, PATH)
    rows = T.read(spark, folder)
    ordered = [r.doc_id for r in rows.orderBy("place").collect()]
    assert ordered == sorted(ordered)
    one = T.read(spark, folder, ids=[5])
    assert "In(doc_id, [5])" in one._jdf.queryExecution().executedPlan().toString() or \
        "EqualTo(doc_id,5)" in one._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in one.collect()] == [5]
    files = [f for f in spark.read.format("binaryFile").load(folder).select("path").collect() if f.path.endswith(".orc")]
    meta = orc.ORCFile(files[0].path.replace("file:", ""))
    assert meta.row_index_stride == T.ROWS_PER_INDEX and meta.nrows > 0


def test_odd_rows(spark, odd):
    got = T.written(odd, PATH).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = expected(rows)
    assert sorted(r.n_tokens for r in got) == sorted(w[2] for w in want)
    assert sorted(r.ids_crc32 for r in got) == sorted(w[3] for w in want)
    # Starts tile the whole sequence.
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)][:2] == [None, None]


def test_added_tokens_and_a_full_cache(monkeypatch):
    e, t = T.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    monkeypatch.setattr(T, "PIECES", 3)
    for text in ("a b c d e f", "x <|endoftext|> y", "z" * 1000 + " q", "", "a b z", " lead", "a  b   c", "x \n y\n z \n\n", "a\u00a0 b \u3000c it's 'll",
                 "q " + "z" * 1000 + " z", " ", "\n ", " \n"):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_runs_of_mixed_white_space():
    """A run of white space is never cut: some merges cross the blanks inside it."""
    e, t = T.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(5)
    spaces = [" ", " ", " \u00a0", "\u00a0", "\u3000", "\t", "\n", "\r\n", "\x85", "\x1c", "\u2009"]
    texts = ["x \u00a0 \u00a0 y", "x" + " \u00a0" * 4 + " y", "x \u3000 \u3000 y", "x \t \t y", "x \n \n y", "x\n \n z ", " \u00a0 \u00a0"]
    texts += ["".join(rng.choice(["a", "1", "'s", "!", "é"]) + "".join(rng.choices(spaces, k=rng.randrange(1, 9)))
                      for _ in range(rng.randrange(1, 12))) for _ in range(600)]
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [87, 11504, 331] and 22686 in want[1]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == want
    assert [np.frombuffer(e.encode([x])[0], "<u4").tolist() for x in texts] == want


def test_white_space_is_what_the_splitter_calls_so():
    """After "a " it starts a word of its own; at such a character no blank is cut."""
    splitter = Tokenizer.from_file(PATH).pre_tokenizer
    for c in (chr(k) for k in range(0x110000) if not 0xD800 <= k < 0xE000):
        if c.isspace():
            assert c in T.SPACES
        elif not c.isalnum():
            assert splitter.pre_tokenize_str("a " + c)[1][0] != "\u0120", hex(ord(c))


def test_empty(spark, empty):
    assert T.written(empty, PATH).count() == 0


def test_pieces_are_told_apart_whatever_they_hold():
    """Ids of texts whose pieces repeat, are empty or lie outside ASCII, in a new cache and in a filled one."""
    library, e = Tokenizer.from_file(PATH), T.PieceEncoder(PATH)
    texts = ["", " ", "é é \U0001f600 é", "a\x00b a\x00b", "a  b", "漢字 漢字 x", "x" * 300 + " y " + "x" * 300] * 3
    want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(texts) == want and e.encode(texts) == want
