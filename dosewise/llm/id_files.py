"""Token-id files in frequency-ranked, byte-aligned variable-length coding.

The tokenizer encodes every text once; ids go to a staged table. Token counts
over all documents rank the ids, so frequent ids get small numbers. A document's
ranks are written in groups of four: one control byte with four two-bit lengths
in a stream of its own, and the 1 to 4 low bytes of each rank in the data
stream. Files hold one row a document (doc_id, ids, control, data), are ranged
and sorted by doc_id, and carry their number. A reader decodes whole batches
with numpy: a table of 256 control bytes gives the lengths, their running sum
the places, and one gather for each byte the ranks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions
from dosewise.llm.token_counts import WHITE
from dosewise.llm.words import ranges
from dosewise.session import scratch_dir, stage

#: Id that ends every document.
END_ID = 0
#: Pieces of text whose ids a Python worker keeps, twice.
KEPT_PIECES = 500_000
#: Pieces that are encoded in one text.
JOINED = 20_000

#: Bytes of text that are cut and looked up at once.
TEXT = 4 << 20

#: Lengths that a control byte stands for.
LENGTHS = np.array([[(c >> (2 * i) & 3) + 1 for i in range(4)] for c in range(256)], np.uint8)


#: White space and what follows it: the tokenizer never joins across these.
_PIECES = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def pieces(text: str) -> list[str]:
    """A text cut where the tokenizer never joins: before white space that follows
    something else. With single blanks any blank will do, which is found faster."""
    if "  " in text or "\0" in text:
        return _PIECES.findall(text)
    return text.replace(" ", "\0 ").split("\0")


class Kept:
    """Pieces and their ids, those of all pieces one after the other."""

    def __init__(self, kind: str) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.end = np.zeros(0, kind), np.zeros(1, np.int64)

    def find(self, names: list[str]) -> np.ndarray:
        """The place of each piece, -1 where it is not kept."""
        return np.array(list(map(self.index.get, names, repeat(-1))), np.int64)

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, and how many each has."""
        sizes = self.end[at + 1] - self.end[at]
        return self.ids[ranges(self.end[at], sizes)], sizes

    def add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.index.update(zip(names, range(len(self.index), len(self.index) + len(names)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(sizes)])


class PieceEncoder:
    """Ids of texts, each distinct piece encoded by the tokenizer once while kept."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Ids are kept in two bytes where the vocabulary allows.
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # bytes of each token: byte-level vocabularies write one character a byte
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        sizes |= {i: len(t.content.encode()) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.lengths = np.zeros(max(sizes) + 1, np.int64)
        self.lengths[list(sizes)] = list(sizes.values())
        self.young, self.old = Kept(self.kind), Kept(self.kind)

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of each text. Texts are cut in Arrow, and only the distinct pieces
        of all of them are looked up."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, "\0"))
        plain = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), " ", "\0 "), "\0")
        others = [pieces(t) for t in texts.filter(odd).to_pylist()]
        flat = pa.concat_arrays([plain.flatten(), pa.array(chain.from_iterable(others), pa.large_string())]).dictionary_encode()
        ids, sizes = self._ids_of(flat.dictionary.to_numpy(zero_copy_only=False).tolist())
        piece = flat.indices.to_numpy()
        ids = ids[ranges((np.cumsum(sizes) - sizes)[piece], sizes[piece])]
        count = np.concatenate([pc.list_value_length(plain).to_numpy(), np.array([len(x) for x in others], np.int64)])
        upto = np.concatenate([[0], np.cumsum(sizes[piece])])[np.concatenate([[0], np.cumsum(count)])]
        rows = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        out = [ids] * len(texts)
        for row, x, y in zip(rows.tolist(), upto.tolist(), upto[1:].tolist(), strict=False):
            out[row] = ids[x:y]
        return out

    def _ids_of(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after the other, and how many each has."""
        at = self.young.find(names)
        lacking = np.flatnonzero(at < 0)
        if len(self.young.index) + len(lacking) > KEPT_PIECES:
            self.old, self.young = self.young, Kept(self.kind)
            lacking = np.arange(len(names))
        if len(lacking):
            wanted = [names[i] for i in lacking.tolist()]
            before = self.old.find(wanted)
            known = before >= 0
            again = np.flatnonzero(known)
            first = len(self.young.index)
            self.young.add(list(compress(wanted, known)), *self.old.ids_of(before[again]))
            order, ids, sizes = self._encoded(list(compress(wanted, ~known)))
            new = np.flatnonzero(~known)[order]
            self.young.add([wanted[i] for i in new.tolist()], ids, sizes)
            at[lacking[np.concatenate([again, new])]] = np.arange(first, first + len(lacking))
        return self.young.ids_of(at)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, their ids in it one after the other, and how many each
        has. Pieces that start with white space and end with something else are encoded
        many in a text, and told apart by the tokens' bytes."""
        among = np.array([p != "" and p[0] in WHITE and p[-1] not in WHITE for p in new], bool)
        inner, rest = list(compress(new, among)), list(compress(new, ~among))
        ends = np.cumsum(pc.binary_length(pa.array(inner, pa.large_string())).to_numpy())
        ids, _ = self._of_library(["".join(inner[i : i + JOINED]) for i in range(0, len(inner), JOINED)])
        upto = np.cumsum(self.lengths[ids])
        at = np.searchsorted(upto, ends)
        if inner and (at[-1] != len(upto) - 1 or (upto[at] != ends).any()):
            return np.arange(len(new)), *self._of_library(new)
        more, sizes = self._of_library(rest)
        order = np.concatenate([np.flatnonzero(among), np.flatnonzero(~among)])
        return order, np.concatenate([ids, more]), np.concatenate([np.diff(at, prepend=-1), sizes])

    def _of_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.int64), *coded]), np.array([len(x) for x in coded], np.int64)


_encoders: dict[str, PieceEncoder] = {}


def encoder_of(path: str) -> PieceEncoder:
    """One encoder for a file in each Python worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _tokenise(path: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def tokenise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for part in portions(batches, size=TEXT):
            texts = part.column("text").fill_null("")
            end = np.array([end_id], encoder.kind).tobytes()
            ids = [x.tobytes() + end for x in encoder.encode(texts)]
            kind = pa.array([encoder.kind] * len(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), kind, pa.array(ids, pa.binary())], ["doc_id", "kind", "ids"])

    return tokenise


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the ids of a task, added up before the shuffle."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for part in portions([batch], "ids"):
            ids = np.frombuffer(b"".join(part.column("ids").to_pylist()), part.column("kind")[0].as_py())
            n = np.bincount(ids, minlength=len(total))
            n[: len(total)] += total
            total = n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks; the last control byte is filled up with zeros."""
    return tuple(x[0].as_py() for x in pack_rows(ranks, np.array([len(ranks)])))


def pack_rows(ranks: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes of each document; the ranks of documents, as many as counts say, follow one another."""
    groups = -(-counts // 4)
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(int(groups.sum()) * 4, np.uint8)
    codes[ranges((np.cumsum(groups) - groups) * 4, counts)] = length - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    upto = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])[np.cumsum(counts)]
    return _binaries(control, np.cumsum(groups)), _binaries(raw[np.arange(4) < length[:, None]], upto)


def _binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes cut at the ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), buffers).cast(pa.binary())


def unpack(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of documents whose control and data bytes follow one another."""
    groups = -(-counts // 4)
    lengths = LENGTHS[control].reshape(-1).astype(np.int64)
    within = np.arange(len(lengths)) - np.repeat((np.cumsum(groups) - groups) * 4, groups * 4)
    lengths = lengths[within < np.repeat(counts, groups * 4)]
    at = np.cumsum(lengths) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    ranks = padded[at].astype(np.uint32)
    for i in (1, 2, 3):
        more = lengths > i
        ranks[more] |= padded[at[more] + i].astype(np.uint32) << np.uint32(8 * i)
    return ranks


def _packed(rank_of: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0  # ids of the file so far: one task writes one file
        for part in portions(batches, "ids"):
            kind = part.column("kind")[0].as_py()
            ids = part.column("ids")
            n = pc.binary_length(ids).to_numpy().astype(np.int64) // np.dtype(kind).itemsize
            control, data = pack_rows(rank_of[np.frombuffer(b"".join(ids.to_pylist()), kind)], n)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(before + np.cumsum(n) - n),
                    pa.array(n),
                    control,
                    data,
                ],
                ["doc_id", "before", "n_ids", "control", "data"],
            )
            before += int(n.sum())

    return packed


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Write files and ranks of docs (doc_id, text, ...) to path/files and path/ranks.

    tokenizer is a JSON file of the tokenizers library on every worker. Null
    texts are empty and hold the end id alone, as do empty ones. Repeated rows
    are all written; rows without doc_id come first. Other columns are ignored.
    The ranks, one for each id in use, are bounded by the vocabulary.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    folder = scratch_dir(docs.sparkSession)
    schema = "doc_id long, kind string, ids binary"
    rows.mapInArrow(_tokenise(tokenizer, end_id), schema).write.option("compression", "zstd").parquet(folder)
    ids = docs.sparkSession.read.schema(schema).parquet(folder)
    counts = ids.select("kind", "ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = stage(counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank")))
    ranked.write.parquet(f"{path}/ranks")
    table = ranked.toPandas()
    rank_of = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table["id"].to_numpy()] = table["rank"].to_numpy()
    (
        ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(
            _packed(rank_of), "doc_id long, before long, n_ids long, control binary, data binary"
        )
        .withColumn("file_no", F.spark_partition_id())
        .write.option("compression", "zstd").parquet(f"{path}/files")
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_ids, ids (little-endian unsigned 32-bit) of every document written to path.

    start is the number of ids in all documents before it.
    """
    files = spark.read.parquet(f"{path}/files")
    table = spark.read.parquet(f"{path}/ranks").toPandas().sort_values("rank")
    id_of = np.append(table["id"].to_numpy(), 0).astype("<u4")
    sizes = files.groupBy("file_no").agg(F.sum("n_ids").alias("size")).orderBy("file_no").collect()  # a row for each file
    bases = dict(zip([r[0] for r in sizes], np.cumsum([0, *(r[1] for r in sizes)]).tolist(), strict=False))

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "data"):
            counts = part.column("n_ids").to_numpy()
            streams = [np.frombuffer(b"".join(part.column(x).to_pylist()), np.uint8) for x in ("control", "data")]
            ids = id_of[unpack(*streams, counts)]
            own = _binaries(ids.view(np.uint8), 4 * np.cumsum(counts))
            base = np.array([bases[f] for f in part.column("file_no").to_pylist()], np.int64)
            start = pa.array(base + part.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), start, part.column("n_ids"), own],
                ["doc_id", "start", "n_ids", "ids"],
            )

    return files.mapInArrow(decoded, "doc_id long, start long, n_ids long, ids binary")
