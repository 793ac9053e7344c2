"""Token ids on disk: one static table of frequencies, independent blocks of interleaved range-ANS lanes, checkpoints, checksums."""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, NOT_SPACE, pieces, span_hashes, words
from tidemark.session import new_folder, stage

# Fixed values of the format.
MAGIC = b"TMR1"
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 1024
BLOCK_TOKENS = 1 << 16  # 256 KiB of plain ids: rows of half a mebibyte or more get heap regions of their own in the JVM
CHECKPOINT_ROWS = 32
HEADER = struct.Struct("<4sIIQIIIIQI")  # magic, documents, lanes, tokens, rows, scale, checkpoint rows, checkpoints, words, crc32
CACHED_WORDS = 1_500_000
LEARN_AT_A_TIME = 2000
ENCODE_BYTES = 1 << 20  # texts encoded at once: a worker holds some 60 bytes of arrays for each byte of them
# Words are cut between an ASCII letter and one of these marks. Marks that the tokenizer can join to letters or that open its special tokens are not here.
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
# Fixed value: the pattern of the tokenizers whose words may be encoded one by one; it joins no white space to anything, and letters to no mark but after '.
WORDS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ENCODERS: dict[tuple[str, int], Encoder] = {}


def words_stand_alone(description: dict) -> bool:
    """Whether a tokenizer's own description says that a text's ids are those of its lower-cased words, cut between letters and marks.

    True only for what is known to be so: white space folded and dropped, lower case, the fixed pattern, special tokens that open with <|.
    """
    def steps(part, list_name):
        return part[list_name] if part and part["type"] == "Sequence" else [part or {"type": None}]

    fold = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    split, *rest = steps(description.get("pre_tokenizer"), "pretokenizers")
    return (
        [n if n == fold else n["type"] for n in steps(description.get("normalizer"), "normalizers")] == ["NFC", fold, "Lowercase"]
        and split == {"type": "Split", "pattern": {"Regex": WORDS_APART}, "behavior": "Removed", "invert": True}
        and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
        and all(t["special"] and t["content"].startswith("<|") for t in description.get("added_tokens", []))
        and not description.get("truncation") and not description.get("padding") and not description["model"].get("dropout")
    )


class Encoder:
    """Whole texts to ids.

    Where the tokenizer's description says so (`words_stand_alone`) a text's ids are those of its words; any other tokenizer gets whole texts. Each word is encoded once and remembered by its hash. Words are lower-cased
    before they are looked up, but for letters that a combining character may follow and pieces that hold a special token.
    What is remembered is bounded by CACHED_WORDS, and forgotten when it is full.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        with open(path, encoding="utf-8") as file:
            self.by_words = words_stand_alone(json.load(file))
        self._reset()

    @staticmethod
    def of(path: str, end_id: int) -> Encoder:
        """The encoder of this Python worker, with what it has learnt in earlier tasks."""
        if (path, end_id) not in _ENCODERS:
            _ENCODERS[path, end_id] = Encoder(path, end_id)
        return _ENCODERS[path, end_id]

    def _reset(self):
        self.known, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.ids, self.offsets = np.zeros(0, np.uint32), np.zeros(1, np.int32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        ids, sizes = [self.ids], []
        for k in range(0, len(texts), LEARN_AT_A_TIME):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + LEARN_AT_A_TIME], add_special_tokens=False)]
            sizes += map(len, got)
            ids.append(np.array([i for g in got for i in g], np.uint32))
        entry = len(self.offsets) - 1 + np.arange(len(texts))
        self.ids = np.concatenate(ids)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes, dtype=np.int32)])
        at = np.searchsorted(self.known, hashes)
        self.known, self.entry = np.insert(self.known, at, hashes), np.insert(self.entry, at, entry)

    def _whole(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = [raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        ids = []
        for k in range(0, len(texts), LEARN_AT_A_TIME):
            ids += [[*e.ids, self.end_id] for e in self.tokenizer.encode_batch_fast(texts[k : k + LEARN_AT_A_TIME], add_special_tokens=False)]
        return np.array([i for g in ids for i in g], np.uint32), np.array([len(g) for g in ids], np.int64)

    def batch(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of all texts of a piece, ids per text), the end id after each text."""
        for first, data, offsets in pieces(column, ENCODE_BYTES):
            raw = data.tobytes()
            if not self.by_words:
                yield first, *self._whole(raw, offsets)
                continue
            if b"<|" not in raw:
                lower = LOWER[data]
                lower[:-1] = np.where(data[1:] >= 128, data[:-1], lower[:-1])
                data, raw = lower, lower.tobytes()
            starts, ends, doc = words(data, offsets, NOT_SPACE)
            cut = np.flatnonzero((_LETTER[data[:-1]] & _MARK[data[1:]]) | (_MARK[data[:-1]] & _LETTER[data[1:]])) + 1
            cut = cut[~np.isin(cut, offsets)]
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
            doc = np.searchsorted(offsets, starts, "right") - 1
            found, at, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
            if len(self.known) > CACHED_WORDS:
                self._reset()
            place = np.searchsorted(self.known, found)
            here = place < len(self.known)
            here[here] = self.known[place[here]] == found[here]
            new = np.flatnonzero(~here)
            if len(new):
                self._learn(found[new], [raw[starts[k] : ends[k]].decode() for k in at[new]])
                place = np.searchsorted(self.known, found)
            entry = self.entry[place][back] if len(found) else np.zeros(0, np.int64)
            begin, size = self.offsets[entry], self.offsets[entry + 1] - self.offsets[entry]
            n = len(offsets) - 1
            per = np.bincount(doc, size, n).astype(np.int64) + 1
            out = np.full(int(per.sum()), self.end_id, np.uint32)
            total = int(size.sum())
            if total:
                before = np.cumsum(size) - size
                source = np.arange(total) + np.repeat(begin - before, size)
                out[np.arange(total) + np.repeat(doc, size)] = self.ids[source]  # one end id for each text before
            yield first, out, per


def frequency_table(counts: dict[int, int]) -> np.ndarray:
    """Frequencies that sum to 2^SCALE, at least 1 for each id that occurs."""
    size = max(counts, default=0) + 1
    n = np.zeros(size, np.int64)
    for k, v in counts.items():
        n[k] = v
    seen = np.flatnonzero(n)
    if not len(seen):
        return n
    share = np.maximum(1, (n[seen] / n.sum() * ((1 << SCALE) - len(seen))).astype(np.int64))
    order = np.argsort(-share, kind="stable")
    rest = (1 << SCALE) - int(share.sum())
    share[order[0]] += rest  # rounding left less than one for each id; the most frequent one takes it
    n[:] = 0
    n[seen] = share
    return n


def encode_block(ids: np.ndarray, freq: np.ndarray, keys: np.ndarray, valid: np.ndarray, per: np.ndarray) -> bytes:
    cum = (np.cumsum(freq) - freq).astype(np.uint64)
    f64 = freq.astype(np.uint64)
    n, lanes = len(ids), LANES
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    shift, low32, word = np.uint64(SCALE), np.uint64(0xFFFFFFFF), np.uint64(32)
    most = np.uint64(((1 << 31) >> SCALE) << 32)
    out, marks, seen = [], [], 0
    for r in range(rows - 1, -1, -1):
        if r != rows - 1 and (r + 1) % CHECKPOINT_ROWS == 0:
            marks.append((r + 1, seen, x.copy()))
        sym = ids[r * lanes : (r + 1) * lanes]
        k = len(sym)
        f, c, y = f64[sym], cum[sym], x[:k]
        full = y >= most * f
        gone = y[full]
        out.append((gone & low32).astype(np.uint32))
        seen += len(gone)
        y[full] = gone >> word
        q = y // f
        x[:k] = (q << shift) + (y - q * f) + c
    stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    parts = [keys.astype("<i8").tobytes(), valid.astype(np.uint8).tobytes(), per.astype("<u4").tobytes(), x.astype("<u8").tobytes()]
    for row, after, state in reversed(marks):  # words that follow a checkpoint were written before it
        parts.append(struct.pack("<IQ", row, len(stream) - after) + state.astype("<u8").tobytes())
    parts.append(stream.astype("<u4").tobytes())
    body = b"".join(parts)
    return HEADER.pack(MAGIC, len(per), lanes, n, rows, SCALE, CHECKPOINT_ROWS, len(marks), len(stream), zlib.crc32(body)) + body


class Block:
    """A block read back: documents and, from the start or any checkpoint, rows of ids."""

    def __init__(self, payload: bytes | pa.Buffer):
        magic, docs, self.lanes, self.n, self.rows, scale, self.every, marks, n_words, crc = HEADER.unpack_from(payload)
        body = memoryview(payload)[HEADER.size :]
        if magic != MAGIC or scale != SCALE:
            raise ValueError("not a block of this format")
        if zlib.crc32(body) != crc:
            raise ValueError("checksum of block does not match")
        at = 0

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(body, kind, count, at)
            at += out.nbytes
            return out

        self.keys, self.valid, self.per, self.state = take("<i8", docs), take("u1", docs).astype(bool), take("<u4", docs), take("<u8", self.lanes)
        self.marks = [(0, 0, self.state)]
        for _ in range(marks):
            row, offset = struct.unpack_from("<IQ", body, at)
            at += 12
            self.marks.append((row, offset, take("<u8", self.lanes)))
        self.stream = take("<u4", n_words)

    def ids(self, table: Table, part: int | None = None) -> np.ndarray:
        """All ids, or those from one checkpoint to the next."""
        at = 0 if part is None else part
        first, pos, x = self.marks[at]
        last = self.rows if part is None or part + 1 == len(self.marks) else self.marks[part + 1][0]
        x, out = x.astype(np.uint64), np.empty(min(self.n, last * self.lanes) - first * self.lanes, np.uint32)
        mask, shift, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        for r in range(first, last):
            k = min(self.lanes, self.n - r * self.lanes)
            y = x[:k]
            slot = y & mask
            sym = table.symbol[slot.astype(np.int64)]
            out[(r - first) * self.lanes : (r - first) * self.lanes + k] = sym
            y = table.freq[sym] * (y >> shift) + slot - table.cum[sym]
            need = y < LOW
            m = int(need.sum())
            y[need] = (y[need] << word) | self.stream[pos : pos + m]
            pos += m
            x[:k] = y
        return out


class Table:
    def __init__(self, freq: np.ndarray):
        self.freq, self.cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


RAW = "file long, block long, start long, keys array<bigint>, per array<bigint>, ids binary"


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole documents, in the order of the task's rows."""
    encoder, file = Encoder.of(path, end_id), TaskContext.get().partitionId()
    ids, keys, per, size, start, number = [], [], [], 0, 0, 0

    def flush():
        nonlocal ids, keys, per, size, start, number
        listed = lambda x: pa.array([x], pa.list_(pa.int64()))
        out = pa.RecordBatch.from_arrays(
            [pa.array([file]), pa.array([number]), pa.array([start]), listed(keys), listed(per), pa.array([np.concatenate(ids).astype("<u4").tobytes()], pa.binary())],
            ["file", "block", "start", "keys", "per", "ids"])
        ids, keys, per, start, size, number = [], [], [], start + size, 0, number + 1
        return out

    for batch in batches:
        key = batch.column("key").to_pylist()
        for first, got, counts in encoder.batch(batch.column("text")):
            ends = np.cumsum(counts)
            at = 0
            while at < len(counts):  # as many documents as the block still holds, one at least
                zero = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, zero + BLOCK_TOKENS - size, "right")))
                ids.append(got[zero : int(ends[to - 1])])
                keys += key[first + at : first + to]
                per += counts[at:to].tolist()
                size += len(ids[-1])
                at = to
                if at < len(counts) or size >= BLOCK_TOKENS:
                    yield flush()
    if per:
        yield flush()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1, np.int64)
    for batch in batches:
        for raw in batch.column("ids"):
            n = np.bincount(np.frombuffer(raw.as_buffer(), "<u4"), minlength=len(total))
            n[: len(total)] += total
            total = n
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]})


def _encode(batches: Iterator[pa.RecordBatch], freq: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            key = batch.column("keys")[k].values
            ids = np.frombuffer(batch.column("ids")[k].as_buffer(), "<u4")
            payload = encode_block(
                ids, freq, pc.fill_null(key, 0).to_numpy(), key.is_valid().to_numpy(False), batch.column("per")[k].values.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).slice(k, 1) for c in ("file", "block", "start")] + [pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())],
                ["file", "block", "start", "n_tokens", "payload"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Write `path`/table (the shared frequencies) and `path`/blocks (blocks of whole documents in ascending id order).

    Texts are dealt out by ranges of the id, one file number for each range, and tokenized once: blocks of plain ids are
    written below the shared folder, counted, and then encoded with the frequencies of all ids of all documents, whose number is bounded by the
    vocabulary. NULL and empty texts are the end id alone; NULL ids come first; rows with equal ids are all written,
    next to each other. The tokenizer file must be readable at `tokenizer` on every executor.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).cast("long").alias("key"), F.col(text).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = slim.repartitionByRange(n, "key").sortWithinPartitions("key")
    raw_path = new_folder(spark, "ids")
    dealt.mapInArrow(lambda it: _tokenize(it, tokenizer, end_id), RAW).write.option("compression", "zstd").parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    counts = raw.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    freq = frequency_table({r["id"]: r["n"] for r in counts.collect()})  # a row for each id of the vocabulary
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").write.parquet(f"{path}/table")
    blocks = raw.mapInArrow(lambda it: _encode(it, freq), "file long, block long, start long, n_tokens long, payload binary")
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids): every document's ids as little-endian 32-bit numbers, and the number of ids of all documents before it.

    Blocks are decoded on their own; what lies before a file comes from the counts of files.
    """
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]

    def decode(batches):
        table = Table(freq)
        for batch in batches:
            for file, start, payload in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), batch.column("payload"), strict=True):
                block = Block(payload.as_buffer())
                raw, ends = block.ids(table).astype("<u4").tobytes(), np.cumsum(block.per.astype(np.int64))
                begins = ends - block.per
                yield pa.RecordBatch.from_arrays([
                    pa.array([file] * len(ends), pa.int64()), pa.array(block.keys, mask=~block.valid), pa.array(begins + start),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    ["file", "key", "inside", "ids"])

    blocks = spark.read.parquet(f"{path}/blocks")
    before = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # one row for each range
    docs = blocks.select("file", "start", "payload").mapInArrow(decode, "file long, key long, inside long, ids binary")
    return docs.join(F.broadcast(stage(files, "files")), "file").select("key", (F.col("before") + F.col("inside")).alias("start"), "ids")
