"""Token ids as ORC files: run-length encoded integers, row indexes, Bloom filters on ids.

Documents are dealt to files by ranges of their id and sorted inside, so
stripe and row-index statistics on the id are narrow and the files, in name order, hold
the documents in ascending order.  ORC's writer encodes the ids as run-length
integers, keeps a row index per ``ROWS_PER_INDEX`` rows and a Bloom filter on the id;
readers split files by stripe and skip stripes and row groups by that metadata.

The vocabulary's library encodes.  Its splitter starts a new word at a blank that has
other characters than white space on both sides, and its merges never cross words, so each
piece between such blanks is encoded once per worker and kept in a cache of fixed size;
Arrow splits texts and tells their pieces apart, and ids are gathered by place.  A
run of white space is never cut; texts with an added token go through the library whole.

Defined cases: a null or empty text has the end id alone; null ids come first;
equal ids are ordered by text hash, repeated rows are rows of their own; an
empty table gives an empty folder that reads back as no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import arrow_map, scratch, stage, width

PIECES = 1_200_000       # pieces a worker keeps
LONG = 256             # characters beyond which a piece is not kept
IDS = 1 << 24          # ids a worker keeps
SLICE = 2 << 20        # bytes of text whose pieces are told apart at once
ROWS_PER_INDEX = 1000
STRIPE_BYTES = 16 << 20
CUT = re.compile(r"(?<=\S) (?=\S)")
#: All that Python calls white space (the splitter calls nothing else so).
SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


#: Texts with a blank at an end or beside other white space are cut by CUT, all others at every blank.
MIXED = f"^ | $| [{SPACES}]|[{SPACES}] "


def gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that begin at ``first`` and are ``size`` long, put together."""
    before = np.cumsum(size) - size
    return values[np.repeat(first - before, size) + np.arange(size.sum())]


class PieceEncoder:
    """The library's tokenizer with a cache of the pieces between blanks."""

    def __init__(self, path: str):
        # Spark's tasks are the parallelism; the library's own threads would only wait for cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab()
        self.size = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.size[i] = len(token)         # byte-level vocabularies write a byte as one letter
        self.special = "|".join([MIXED, *(re.escape(a) for a in self.added)])
        self._clear()

    def _clear(self) -> None:
        self.first: dict[str, int] = {}       # places of pieces that begin a text
        self.rest: dict[str, int] = {}        # places of pieces after a blank
        self.ids = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 14, np.int64)   # where the ids of a place begin, and behind the last one where they end
        self.places = 0

    def _store(self, new: list[bytes]) -> int:
        """Keep the ids of new pieces; the first one's place."""
        ids, size = np.frombuffer(b"".join(new), "<u4"), np.array([len(x) // 4 for x in new], np.int64)
        used, first = int(self.at[self.places]), self.places
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(max(len(ids), used), np.uint32)))
        if first + len(new) >= len(self.at):
            self.at = np.concatenate((self.at, np.zeros(max(len(new) + 1, first), np.int64)))
        self.ids[used:used + len(ids)] = ids
        self.at[first + 1:first + 1 + len(new)] = used + np.cumsum(size)
        self.places += len(new)
        return first

    def _placed(self, kept: dict[str, int], pieces: pa.Array, encode) -> np.ndarray:
        """The place of every piece; those not kept yet are encoded together."""
        told = pieces.dictionary_encode()
        told = told.combine_chunks() if isinstance(told, pa.ChunkedArray) else told
        # By numpy's objects, several times faster than one Arrow scalar after the other.
        distinct = told.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = list(map(kept.get, distinct))
        missing = [k for k, x in enumerate(places) if x is None]
        if missing:
            first = self._store(encode([distinct[k] for k in missing]))
            for place, k in enumerate(missing, first):
                places[k] = place
                if len(distinct[k]) <= LONG:
                    kept[distinct[k]] = place
        return np.array(places, np.int64)[told.indices.to_numpy(zero_copy_only=False)]

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of " " + piece for each, from one text: where a piece ends is told by its bytes."""
        out: list[bytes] = []
        for k in range(0, len(pieces), 1024):
            part = pieces[k:k + 1024]
            text = " " + " ".join(part)
            if any(a in text for a in self.added):     # only pieces put together make one
                out += self._library([" " + p for p in part])
                continue
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) + 1 for p in part])) + 1
            data = ids.tobytes()
            out += [data[4 * a:4 * z] for a, z in zip([0, *ends.tolist()], ends.tolist())]
        return out

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray | None]:
        """All pieces, their number per text, and the order of the texts (None: as given)."""
        special = pc.match_substring_regex(texts, self.special)
        plain = pc.split_pattern(texts.filter(pc.invert(special)), " ")
        pieces, size = plain.flatten(), pc.list_value_length(plain).to_numpy(zero_copy_only=False)
        apart = np.flatnonzero(special.to_numpy(zero_copy_only=False))
        if not len(apart):
            return pieces, size, None
        more = [[t] if any(a in t for a in self.added) else CUT.split(t) for t in texts.take(pa.array(apart)).to_pylist()]
        pieces = pa.concat_arrays([pieces, pa.array([p for ps in more for p in ps], pieces.type)])
        order = np.concatenate((np.setdiff1d(np.arange(len(texts)), apart), apart))
        return pieces, np.concatenate((size, [len(ps) for ps in more])), order

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none of them null), and their number per text."""
        if len(self.first) + len(self.rest) > PIECES or self.at[self.places] > IDS:
            self._clear()
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces, size, order = self._cut(texts)
        ends = np.cumsum(size)
        begins = np.zeros(len(pieces), bool)
        begins[ends - size] = True
        place = np.empty(len(pieces), np.int64)
        # First pieces have no blank before them, and some texts can't be cut.
        place[begins] = self._placed(self.first, pieces.filter(pa.array(begins)), self._library)
        place[~begins] = self._placed(self.rest, pieces.filter(pa.array(~begins)), self._spaced)
        first, n = self.at[place], self.at[place + 1] - self.at[place]
        ids, n = gather(self.ids, first, n), np.add.reduceat(n, ends - size)
        if order is None:
            return ids, n
        back = np.argsort(order)
        return gather(ids, (np.cumsum(n) - n)[back], n[back]), n[back]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, n = self.encode_array(pa.array(texts, pa.string()))
        ends, data = np.cumsum(n), ids.astype("<u4").tobytes()
        return [data[4 * a:4 * z] for a, z in zip((ends - n).tolist(), ends.tolist())]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write(docs: DataFrame, folder: str, vocabulary: str, text: str = "text", id_col: str = "doc_id",
          end_id: int = 2) -> None:
    """Write (id_col, place, ids) to ``folder`` as ORC in ascending order of the id.

    ``place`` ascends over all documents: the run's number in its high 31 bits,
    the position in the run in the low 33.
    """
    rows = docs.select(F.col(id_col), F.col(text).alias("t"))
    order = [F.col(id_col).asc_nulls_first(), F.xxhash64("t")]
    rows = (rows.repartitionByRange(width(docs), *order).sortWithinPartitions(*order)
            .withColumn("place", F.monotonically_increasing_id()))

    def apply(batches):
        e = encoder(vocabulary)
        for b in batches:
            t = pc.fill_null(b.column("t"), "")
            # A slice ends where the texts pass the next multiple of its size.
            passed = np.cumsum(pc.binary_length(t).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(passed)) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                part = b.slice(at, to - at)
                ids, n = e.encode_array(t.slice(at, to - at))
                ends = np.cumsum(n)
                ids = np.insert(ids.view(np.int32), ends, end_id)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends + np.arange(1, len(n) + 1)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("place"), lists], names=[id_col, "place", "ids"])
    schema = StructType([docs.schema[id_col], StructField("place", LongType()), StructField("ids", ArrayType(IntegerType()))])
    (arrow_map(rows, apply, schema).write
     .option("orc.bloom.filter.columns", id_col).option("orc.bloom.filter.fpp", "0.01")
     .option("orc.row.index.stride", ROWS_PER_INDEX).option("orc.stripe.size", STRIPE_BYTES)
     .option("compression", "zstd").orc(folder))


def read(spark: SparkSession, folder: str, id_col: str = "doc_id", id_type=None, ids: list | None = None) -> DataFrame:
    """(id_col, place, ids) of the files; a list of ``ids`` is pushed to stripes, row indexes and Bloom filters."""
    schema = StructType([StructField(id_col, id_type or LongType()), StructField("place", LongType()),
                         StructField("ids", ArrayType(IntegerType()))])
    rows = spark.read.schema(schema).orc(folder)
    return rows if ids is None else rows.filter(F.col(id_col).isin(ids))


def placed(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of read files: where each document's ids stand among all.

    Files hold ascending runs of documents, so a document starts where its
    run does (the sizes of the runs before; one row per run) plus what stands
    before it in the run.
    """
    def measure(batches):
        for b in batches:
            lists = b.column("ids")
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), b.column("place"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                names=[id_col, "place", "n_tokens", "ids_crc32"])
    schema = StructType([rows.schema[id_col], *(StructField(n, LongType()) for n in ("place", "n_tokens", "ids_crc32"))])
    sizes = stage(arrow_map(rows.select(id_col, "place", "ids"), measure, schema)
                  .withColumn("run", F.shiftright("place", 33).cast("int")), "sizes")
    totals = {r[0]: r[1] for r in sizes.groupBy("run").agg(F.sum("n_tokens")).collect()}   # a row per run
    starts, total = [], 0
    for run in sorted(totals):
        starts.append((run, total))
        total += totals[run]
    before = Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.sparkSession.createDataFrame(starts, "run int, offset long")
    # One row per written file: bounded by the number of write tasks.
    return (sizes.withColumn("inside", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
            .join(F.broadcast(runs), "run")
            .select(id_col, (F.col("offset") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"))


def written(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new shared folder, read the files back and place every document."""
    spark, folder = docs.sparkSession, scratch(docs.sparkSession, "tokens")
    write(docs, folder, vocabulary, text, id_col, end_id)
    return placed(read(spark, folder, id_col, docs.schema[id_col].dataType), id_col)
