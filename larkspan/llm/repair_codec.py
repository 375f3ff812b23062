"""Token-id files by Re-Pair grammar compression.

Texts are dealt by ranges of their id, sorted, encoded and gathered to shards. In each shard frequent pairs of
neighbouring symbols are replaced by new symbols, round after round, until no pair comes often enough to pay for its
rule. A round replaces many pairs: each place goes to a pair that is at least as frequent as those it overlaps with. After the
first round only places next to a new symbol, and places of pairs that were frequent, are counted again.

A shard keeps its rules, the length to which each rule expands, the remaining sequence and its index of texts, so any
range of ids decodes without the rest. A shard is one binary value of a table, written and read by Spark: a lost or
repeated task leaves no broken file.

File format of a shard, little-endian: magic, then seven counts as u64 (version, texts, ids, rules, symbols, first new
symbol, bits of a symbol), the rules' expansion lengths as u32, ids in each text as u64, text ids as i64, a byte for
each that is 1 for a null id, the left and the right symbols of the rules, and the sequence. Symbols are stored as their low 16 bits as u16,
then a plane of packed bits for each higher bit.

A null text is an empty one; each text ends with the end id, so none has zero ids. A text of any length is one text of a
shard, alone if it is long. Texts with one id are ordered by their text. Null ids come first. Columns other than the id and the text are
ignored. Empty tables give empty tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C
from .tokens import encoder, tokenizer_path

MAGIC = b"LARKRP02"
#: Ids in a shard, at which it is closed; a longer text has a shard to itself.
SHARD = 1 << 19
#: Uses that pay for a rule: it takes two symbols and a length of four bytes, and each use saves a symbol of over 16 bits.
LEAST = 4
_BITS = 18

SHARDS = "part int, shard int, n_ids long, blob binary"


def _slot(pair: np.ndarray) -> np.ndarray:
    return ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)


def compress(ids: np.ndarray, vocabulary: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (k, 2) and the rules' expansion lengths; rule i makes symbol vocabulary + i."""
    seq = ids.astype(np.int64)
    rules, lengths = [np.zeros((0, 2), np.int64)], np.ones(vocabulary, np.int64)
    at = np.arange(max(0, len(seq) - 1))  # where pairs may be frequent
    pair = seq[:-1] << 32 | seq[1:]
    # Pairs are first counted by a hash; exact counts are taken of those that may be frequent.
    slot = _slot(pair)
    may = np.flatnonzero(np.bincount(slot, minlength=1 << _BITS)[slot] >= least)
    at, pair, slot = at[may], pair[may], slot[may]
    while len(at):
        order = np.sort(pair)
        edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        n = np.diff(np.append(edge, len(order)))
        often = n >= least
        name, n = order[edge[often]], n[often]
        if not len(name):
            break
        rank = np.argsort(n, kind="stable")
        name, n = name[rank], n[rank]
        most = len(name)
        while True:
            # Of pairs in one slot the most frequent is taken now, the others in a later round.
            table = np.full(1 << _BITS, -1, np.int32)
            table[_slot(name[-most:])] = np.arange(len(name) - most, len(name), dtype=np.int32)
            rule = table[slot]
            taken = rule >= 0
            taken &= name[rule] == pair
            score = np.where(taken, n[rule], 0)
            # Each place goes to the more frequent pair; of equal ones in a row every other is taken, from the left.
            best = taken.copy()
            beside = at[1:] == at[:-1] + 1
            best[1:] &= ~beside | (score[1:] >= score[:-1])
            best[:-1] &= ~beside | (score[:-1] >= score[1:])
            here, which = at[best], rule[best]
            first = np.ones(len(here), bool)
            first[1:] = here[1:] != here[:-1] + 1
            run = np.maximum.accumulate(np.where(first, here, 0))
            free = (here - run) & 1 == 0
            here, which = here[free], which[free]
            keep = np.bincount(which, minlength=len(name)) >= least
            if keep.any() or most == 1:
                break
            most = max(1, most // 8)  # fewer pairs are in each other's way
        if not keep.any():
            break
        use = keep[which]
        here, which = here[use], (np.cumsum(keep) - 1)[which[use]]
        new = np.stack([name[keep] >> 32, name[keep] & 0xFFFFFFFF], axis=1)
        seq[here] = len(lengths) + which
        rules.append(new)
        lengths = np.concatenate([lengths, lengths[new[:, 0]] + lengths[new[:, 1]]])
        stay = np.ones(len(seq), bool)
        stay[here + 1] = False
        # Pairs that are not frequent now can only become so with a new symbol.
        at = at[table[slot] >= 0] if most == len(name) else at
        mark = np.zeros(len(seq), bool)
        mark[at] = True
        mark[here] = True
        before = here - 1 - ~stay[here - 1]  # a place that goes leaves its left neighbour
        mark[before[here > 0]] = True
        at = np.flatnonzero(mark[stay])
        seq = seq[stay]
        if len(at) and at[-1] == len(seq) - 1:
            at = at[:-1]
        pair = seq[at] << 32 | seq[at + 1]
        slot = _slot(pair)
    return seq, np.concatenate(rules), lengths[vocabulary:]


def expansions(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of all rules, one rule after another."""
    seq = rules.reshape(-1).astype(np.int64)
    while len(seq) and (new := seq >= vocabulary).any():
        size = 1 + new
        head = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.int64)
        out[head] = np.where(new, rules[np.where(new, seq - vocabulary, 0), 0], seq)
        out[head[new] + 1] = rules[seq[new] - vocabulary, 1]
        seq = out
    return seq


def _planes(symbols: np.ndarray, bits: int) -> bytes:
    return (symbols & 0xFFFF).astype("<u2").tobytes() + b"".join(np.packbits((symbols >> k & 1).astype(np.uint8)).tobytes() for k in range(16, bits))


def _unplaned(blob: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    out = np.frombuffer(blob, "<u2", n, at).astype(np.int64)
    at += 2 * n
    for k in range(16, bits):
        out |= np.unpackbits(np.frombuffer(blob, np.uint8, (n + 7) // 8, at), count=n).astype(np.int64) << k
        at += (n + 7) // 8
    return out, at


def pack_shard(doc_ids: list[int | None], texts: list[np.ndarray], vocabulary: int) -> bytes:
    ids = np.concatenate(texts)
    symbols, rules, lengths = compress(ids, vocabulary)
    bits = max(16, int(vocabulary + len(rules) - 1).bit_length())
    head = np.array([2, len(texts), len(ids), len(rules), len(symbols), vocabulary, bits], "<u8")
    index = np.array([0 if x is None else x for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), lengths.astype("<u4").tobytes(), np.array([len(x) for x in texts], "<u8").tobytes(), index[0].tobytes(), index[1].tobytes(), _planes(rules[:, 0], bits), _planes(rules[:, 1], bits), _planes(symbols, bits)])


class Shard:
    """A shard's bytes, opened: the rules are expanded, the sequence is not."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("no token shard")
        version, docs, self.n_ids, rules, symbols, self.vocabulary, bits = np.frombuffer(blob, "<u8", 7, 8).tolist()
        if version != 2:
            raise ValueError(f"token shard of version {version}")
        at = 64
        self.lengths = np.frombuffer(blob, "<u4", rules, at).astype(np.int64)
        at += 4 * rules
        self.sizes = np.frombuffer(blob, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        ids, null = np.frombuffer(blob, "<i8", docs, at), np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else x for x, z in zip(ids.tolist(), null.tolist(), strict=True)]
        left, at = _unplaned(blob, at + 9 * docs, rules, bits)
        right, at = _unplaned(blob, at, rules, bits)
        self.rules = np.stack([left, right], axis=1)
        self.symbols, _ = _unplaned(blob, at, symbols, bits)
        # The ids that each symbol stands for: itself, or a stretch of the rules' ids.
        self.ids = np.concatenate([np.arange(self.vocabulary), expansions(self.rules, self.vocabulary)]).astype(np.uint32)
        size = np.concatenate([np.ones(self.vocabulary, np.int64), self.lengths])
        self.size, self.head = size[self.symbols], (np.cumsum(size) - size)[self.symbols]
        self.ends = np.cumsum(self.size)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _range(self, start: int, stop: int, i: int, j: int) -> np.ndarray:
        n = self.size[i:j]
        ends = self.ends[i:j]
        first = int(ends[0] - n[0])
        out = self.ids[np.repeat(self.head[i:j] - (ends - n - first), n) + np.arange(int(ends[-1]) - first)]
        return out[start - first : stop - first]

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop: only the symbols that reach into the range are expanded."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        return self._range(start, stop, int(np.searchsorted(self.ends, start, side="right")), int(np.searchsorted(self.ends, stop)) + 1)

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k] + self.sizes[k]))

    def documents(self) -> Iterator[np.ndarray]:
        """Each text by its range."""
        stops = self.starts + self.sizes
        i, j = np.searchsorted(self.ends, self.starts, side="right"), np.searchsorted(self.ends, stops) + 1
        for span in zip(self.starts.tolist(), stops.tolist(), i.tolist(), j.tolist(), strict=True):
            yield self._range(*span) if span[0] < span[1] else self.ids[:0]


def write_shards(spark: SparkSession, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, shard: int = SHARD) -> DataFrame:
    """Encode docs and write their shards, to path or the shared folder; returns the table of shards, read back."""
    C.arrow_limits(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        vocabulary = enc.inner.get_vocab_size()
        part, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list = []
        held = 0

        def close() -> pa.RecordBatch:
            blob = pack_shard(ids, texts, max(vocabulary, end_id + 1))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["part", "shard", "n_ids", "blob"])

        for batch in batches:
            column = batch.column(1)
            for i, j in C.parts(column):
                for k, x in zip(batch.column(0)[i:j].to_pylist(), enc.encode(column.slice(i, j - i)), strict=True):
                    if held and held + len(x) + 1 > shard:
                        yield close()
                        ids, texts, held, number = [], [], 0, number + 1
                    ids.append(k)
                    texts.append(np.append(x, end_id).astype(np.uint32))
                    held += len(x) + 1
        if held:
            yield close()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(encode, SHARDS)
    if path is None:
        return C.scratch(made, "token-shards")
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def read_shards(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids_crc32, shard_bytes (its shard's size), shard_tokens."""
    C.arrow_limits(spark)
    # A sum for each part, then for each shard of a part: the first table has a row for each range of ids.
    sums = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sums.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")
    starts = shards.select("part", "shard", inner.alias("inner")).join(F.broadcast(before), "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("at"))
    starts = C.scratch(starts, "shard-starts")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()  # a worker that has encoded before
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = blob.as_py()
                s = Shard(raw)
                crc = [zlib.crc32(np.ascontiguousarray(x, "<u4")) for x in s.documents()]
                n = len(crc)
                yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(s.starts + at), pa.array(s.sizes), pa.array(crc, pa.int64()), pa.array([len(raw)] * n, pa.int64()), pa.array([s.n_ids] * n, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard_bytes", "shard_tokens"])

    return shards.join(starts, ["part", "shard"]).select("at", "blob").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, shard_bytes long, shard_tokens long")
