"""Token-id shards with a minimal perfect hash index.

Shard file (little-endian): the magic ``TOKS0001``; the raw ids of its documents one after another, each an unsigned
integer of 2 bytes (4 where the vocabulary needs them), every document closed by the end id; a table of the
documents, 24 bytes each (doc_id int64, first id int64, number of ids int64); and the footer (documents int64,
ids int64, bytes of an id int64). Shards follow one another in ascending doc_id order.

Index file, one for each hash bucket of the keys: levels of a minimal perfect hash (bit arrays; a key sits at the
first level where no other key shares its bit, keys left after the last level are listed in order) and one slot per
key with a 32-bit fingerprint, the shard, the first id and the number of ids. A lookup touches one bucket, a bit per
level and one slot, and reads one range of one shard. The key of a row is its doc_id and how many equal ids come
before it; a null id is a key of its own.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalint.llm.common import cut, open_folder, scratch_folder, shuffle_width, write_whole
from metalint.llm.wordhash import batches_of, hash_spans, mix, text_bytes, word_spans

MAGIC = b"TOKS0001"
END_ID = 2
SHARD_IDS = 128_000_000
BUCKET_KEYS = 1_000_000
LEVELS = 24
_NULL_ID = -(2**63)
_DOC = np.dtype([("doc_id", "<i8"), ("first", "<i8"), ("n", "<i8")])
_SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<i8"), ("n", "<i8")])
#: Words that a worker remembers, some 30 bytes each, and words encoded together; a worker outlives its task.
_MEMO, _RUN = 2_500_000, 64
_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x09, 0x0A, 0x0D]] = True
_encoders: dict[str, WordEncoder] = {}


def _pieces(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _steps(spec: dict | None, inner: str) -> list[dict]:
    return [] if spec is None else spec[inner] if spec["type"] == "Sequence" else [spec]


def letters_go_whole(tokenizer) -> bool:
    """True where all that happens to a word of A-Z and a-z before the model is that it is lower-cased.

    Read from the tokenizer's own description: normalizers that compose characters, replace white space and lower case;
    a split that keeps runs of letters, with nothing tried before these but what begins with an apostrophe; bytes as
    they are; and no added token of letters alone. Any other tokenizer gives False.
    """
    spec = json.loads(tokenizer.to_str())
    normal, before = _steps(spec["normalizer"], "normalizers"), _steps(spec["pre_tokenizer"], "pretokenizers")
    kinds = [n["type"] for n in normal]
    blanks = all(n["pattern"] == {"Regex": r"\s+"} for n in normal if n["type"] == "Replace")
    if not set(kinds) <= {"NFC", "NFKC", "Replace", "Lowercase"} or "Lowercase" not in kinds or not blanks or [b["type"] for b in before] != ["Split", "ByteLevel"]:
        return False
    split, level = before
    tried = split["pattern"].get("Regex", "").split("|")
    letters = r"[\p{L}]+"
    whole = split["behavior"] == "Removed" and split["invert"] and letters in tried and all(t.startswith("'") for t in tried[:tried.index(letters)])
    return whole and not level["add_prefix_space"] and not level["use_regex"] and not any(t["content"].isalpha() for t in spec["added_tokens"])


class _Run:
    """Sorted keys of words, the place and number of each one's ids, and if it was met again since the last clearing."""

    def __init__(self, *columns: np.ndarray):
        self.columns = columns or (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))

    def __len__(self) -> int:
        return len(self.columns[0])

    def merged(self, other: _Run) -> _Run:
        both = [np.concatenate(c) for c in zip(self.columns, other.columns, strict=True)]
        order = np.argsort(both[0], kind="stable")
        return _Run(*(c[order] for c in both))

    def look_up(self, asked: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        """Fill in place and number of those asked keys, in order, that this run has."""
        keys, places, counts, met = self.columns
        if not len(keys):
            return
        at = np.searchsorted(keys, asked)
        at[at == len(keys)] = 0
        hit = keys[at] == asked
        first[hit], n[hit], met[at[hit]] = places[at[hit]], counts[at[hit]], True


class WordMemo:
    """Ids of words by the words' 64-bit hashes, in arrays: a long run of keys, a short one that takes new words, and all ids.

    When there are more than _MEMO words, those met again since the last time stay, at most half as many.
    """

    def __init__(self, dtype: np.dtype):
        self.long, self.short, self.ids, self.filled = _Run(), _Run(), np.zeros(1024, dtype), 0

    def append(self, ids: np.ndarray) -> int:
        """The place that the ids get."""
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:self.filled], np.zeros(self.filled // 2 + len(ids), self.ids.dtype)])
        self.ids[self.filled:self.filled + len(ids)] = ids
        self.filled += len(ids)
        return self.filled - len(ids)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each of the keys, which are in order; the number is -1 for those not known."""
        first, n = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int32)
        for run in (self.long, self.short):
            run.look_up(keys, first, n)
        return first, n

    def learn(self, keys: np.ndarray, coded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Take new keys, in order, with their ids as bytes; place and number of each."""
        n = np.array([len(c) for c in coded], np.int32) // np.int32(self.ids.itemsize)
        first = np.cumsum(n, dtype=np.int64) - n + self.append(np.frombuffer(b"".join(coded), self.ids.dtype))
        self.short = self.short.merged(_Run(keys, first, n, np.zeros(len(keys), bool)))
        if len(self.short) > max(32_768, len(self.long) // 8):
            self.long, self.short = self.long.merged(self.short), _Run()
        return first, n

    def clear(self) -> None:
        """Forget words, if there are too many; places given out before are not valid afterwards."""
        if len(self.long) + len(self.short) <= _MEMO:
            return
        keys, first, n, met = self.long.merged(self.short).columns
        kept = np.flatnonzero(met)[:_MEMO // 2]
        keys, first, n = keys[kept], first[kept], n[kept]
        ids = self.ids[_spread(first, n)]
        self.ids, self.filled = ids, len(ids)
        self.long, self.short = _Run(keys, np.cumsum(n, dtype=np.int64) - n, n, np.zeros(len(keys), bool)), _Run()


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of pieces that begin at first and have n places each."""
    return np.repeat(first - (np.cumsum(n, dtype=np.int64) - n), n) + np.arange(int(n.sum(dtype=np.int64)))


class WordEncoder:
    """Ids of texts from those of the pieces between blanks, which the tokenizers library encodes when they are first met.

    Only for tokenizers that never join characters across white space, which the constructor checks on a sample; others
    encode whole texts. Pieces are told apart by 64-bit hashes.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = None
        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size() - 1, end_id)
        self.dtype = np.dtype("<u2" if size < 2**16 else "<u4")
        self.end = np.array([end_id], self.dtype)
        self.memo = WordMemo(self.dtype)
        sample = " Don't  stop\n\tat 3.14 of it,\r\n café <b> 42nd "
        pieces = [i for w in _pieces(sample) for i in self._ids(w)]
        self.by_word = pieces == self._ids(sample)
        if self.by_word and letters_go_whole(self.tokenizer):
            self.model = self.tokenizer.model
        marks = [(m, self._ids(m)) for m in "|~^"]
        self.mark = next(((m, ids[0]) for m, ids in marks if len(ids) == 1 and self._ids(f"a {m} b") == [*self._ids("a"), *ids, *self._ids("b")]), None)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []

    def _words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word, _RUN of them encoded as one text; words that reach the model whole go to it straight."""
        out, fresh = [b""] * len(words), []
        for i, word in enumerate(words):
            if self.model is not None and word.isascii() and word.isalpha():
                out[i] = array(self.dtype.char, [t.id for t in self.model.tokenize(word.lower())]).tobytes()
            else:
                fresh.append(i)
        for at in range(0, len(fresh), _RUN):
            run = fresh[at:at + _RUN]
            for i, data in zip(run, self._run_ids([words[i] for i in run]), strict=True):
                out[i] = data
        return out

    def _run_ids(self, run: list[str]) -> list[bytes]:
        """Ids of each word of a run: one call for all, with a mark between them whose single id tells them apart."""
        if self.mark is not None:
            text, mark = self.mark
            [got] = self.tokenizer.encode_batch_fast([f" {text} ".join(run)], add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            ends = np.flatnonzero(ids == mark)
            if len(ends) == len(run) - 1:  # else a word holds the mark itself
                data, width = ids.tobytes(), self.dtype.itemsize
                bounds = [-1, *ends.tolist(), len(ids)]
                return [data[(low + 1) * width:high * width] for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
        return [np.array(got.ids, self.dtype).tobytes() for got in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]

    def encode_all(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of each text with the end id, as bytes."""
        if not self.by_word:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            return [np.array(self._ids(t or ""), self.dtype).tobytes() + self.end.tobytes() for t in texts]
        raw, offsets = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
        starts, ends, bounds = word_spans(raw, offsets, _BREAK)
        keys, sample, at = np.unique(hash_spans(raw, starts, ends), return_index=True, return_inverse=True)
        first, n = self.memo.look_up(keys)
        new = np.flatnonzero(n < 0)
        if len(new):
            data, spans = raw.tobytes(), zip(starts[sample[new]].tolist(), ends[sample[new]].tolist(), strict=True)
            first[new], n[new] = self.memo.learn(keys[new], self._words_ids([data[lo:hi].decode() for lo, hi in spans]))
        end = self.memo.append(self.end)
        lengths = np.insert(n[at], bounds[1:], 1)
        coded = self.memo.ids[_spread(np.insert(first[at], bounds[1:], end), lengths)].tobytes()
        edges = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.concatenate([[0], bounds[1:] + np.arange(1, len(bounds))])]
        edges = (edges * self.dtype.itemsize).tolist()
        self.memo.filled = end
        self.memo.clear()
        return [coded[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]


def encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder per worker process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path, end_id)
    return _encoders[path]


def _shard_writer(path: str, end_id: int, folder: str):
    """Writes the documents of a task, already in order, as shards of at most SHARD_IDS ids (or one document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, end_id)
        piece = pyspark.TaskContext.get().partitionId()
        made, ids, table, total = [], [], [], 0

        def close() -> None:
            nonlocal ids, table, total
            name = f"shard-{piece:06d}-{len(made):04d}.tok"
            docs = np.array(table, _DOC)
            footer = np.array([len(docs), total, code.dtype.itemsize], "<i8").tobytes()
            write_whole(folder, name, b"".join([MAGIC, *ids, docs.tobytes(), footer]))
            edge = [docs["doc_id"][0], docs["doc_id"][-1]]
            made.append((name, len(docs), total, int(edge[0]), int(edge[1]),
                         int((docs["doc_id"] == edge[0]).sum()), int((docs["doc_id"] == edge[1]).sum())))
            ids, table, total = [], [], 0

        for batch in batches_of(batches, 512):
            coded = code.encode_all(batch.column("text"))
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), coded, strict=True):
                n = len(data) // code.dtype.itemsize
                if table and total + n > SHARD_IDS:
                    close()
                ids.append(data)
                table.append((_NULL_ID if doc_id is None else doc_id, total, n))
                total += n
        if table:
            close()
        columns = list(zip(*made, strict=True)) or [[]] * 7
        names = ["name", "docs", "ids", "low", "high", "of_low", "of_high"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 0 else pa.int64()) for i, c in enumerate(columns)], names=names)

    return run


def write_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write docs (doc_id, text); returns the shard list with each shard's number and first global id."""
    wide = shuffle_width(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")]
    placed = docs.repartitionByRange(wide, *order).sortWithinPartitions(*order).select("doc_id", "text")
    made = cut(placed.mapInArrow(
        _shard_writer(path, end_id, folder), "name string, docs long, ids long, low long, high long, of_low long, of_high long"))
    # One row per shard of up to SHARD_IDS ids.
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    made = made.withColumn("shard", F.row_number().over(Window.orderBy("name")) - 1)
    made = made.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    # Rows with a shard's lowest id that earlier shards have: of those shards only the last ids can be equal to it.
    same = Window.partitionBy("edge").orderBy("shard", "side").rowsBetween(Window.unboundedPreceding, -1)
    edges = made.select("shard", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("low").alias("edge"), F.when(F.col("low") == F.col("high"), 0).otherwise(F.col("of_low")).alias("n")),
        F.struct(F.lit(1).alias("side"), F.col("high").alias("edge"), F.col("of_high").alias("n")))).alias("x")).select("shard", "x.*")
    earlier = edges.withColumn("carried", F.coalesce(F.sum("n").over(same), F.lit(0))).where("side = 0").select("shard", "carried")
    return cut(made.join(earlier, "shard"))


def keys_of(doc_ids: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """64-bit keys; one to one for rows that are the first with their id."""
    return mix(doc_ids.astype(np.int64).view(np.uint64)) ^ mix(turns.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F % 2**64)) % np.uint64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of the levels, then the keys that no level could place, in order."""
    levels, left = [], keys
    while len(left) and len(levels) < LEVELS:
        bits = np.zeros(max(64, 2 * len(left)), bool)
        at = _bit(left, len(levels), len(bits))
        alone = np.bincount(at, minlength=len(bits))[at] == 1
        bits[at[alone]] = True
        levels.append(bits)
        left = left[~alone]
    return [*levels, np.sort(left)]


def slots_of(table: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, from 0 to one less than all keys; any slot or -1 for a key that isn't in the table."""
    out = np.full(len(keys), -1, np.int64)
    left, before = np.arange(len(keys)), 0
    for level, bits in enumerate(table[:-1]):
        at = _bit(keys[left], level, len(bits))
        here = bits[at]
        rank = np.cumsum(bits) - 1
        out[left[here]] = before + rank[at[here]]
        before += int(bits.sum())
        left = left[~here]
    rest = table[-1]
    at = np.searchsorted(rest, keys[left])
    found = at < len(rest)
    found[found] = rest[at[found]] == keys[left][found]
    out[left[found]] = before + at[found]
    return out


def _pack(table: list[np.ndarray], slots: np.ndarray) -> bytes:
    head = np.array([len(table) - 1, len(table[-1]), len(slots), *(len(b) for b in table[:-1])], "<i8")
    return b"".join([head.tobytes(), *(np.packbits(b).tobytes() for b in table[:-1]), table[-1].astype("<u8").tobytes(), slots.tobytes()])


def _unpack(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    levels, rest, n = np.frombuffer(data, "<i8", 3)
    sizes = np.frombuffer(data, "<i8", int(levels), 24)
    at, table = 24 + 8 * int(levels), []
    for size in sizes:
        table.append(np.unpackbits(np.frombuffer(data, np.uint8, (size + 7) // 8, at), count=int(size)).view(bool))
        at += (int(size) + 7) // 8
    table.append(np.frombuffer(data, "<u8", int(rest), at))
    return table, np.frombuffer(data, _SLOT, int(n), at + 8 * int(rest))


def _read_file(folder: str, name: str, first: int = 0, size: int | None = None) -> bytes:
    store, path = open_folder(folder)
    with store.open_input_file(f"{path}/{name}") as src:
        src.seek(first)
        return src.read(src.size() - first if size is None else size)


def _tables_reader(folder: str, buckets: int):
    """Keys and places of all documents, from the tables at the shards' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['name']}") as src:
                    size = src.size()
                    src.seek(size - 24)
                    n, _, _ = np.frombuffer(src.read(24), "<i8")
                    src.seek(size - 24 - int(n) * _DOC.itemsize)
                    docs = np.frombuffer(src.read(int(n) * _DOC.itemsize), _DOC)
                first = np.concatenate([[True], docs["doc_id"][1:] != docs["doc_id"][:-1]])
                turn = np.arange(len(docs)) - np.maximum.accumulate(np.where(first, np.arange(len(docs)), 0))
                turn = turn + np.where(docs["doc_id"] == docs["doc_id"][0], row["carried"], 0)
                keys = keys_of(docs["doc_id"], turn)
                for at in range(0, len(docs), 65536):
                    part = slice(at, at + 65536)
                    yield pa.RecordBatch.from_arrays([
                        pa.array((mix(keys[part] ^ np.uint64(99)) % np.uint64(buckets)).astype(np.int32)), pa.array(keys[part].view(np.int64)),
                        pa.array(docs["doc_id"][part]), pa.array(turn[part]), pa.array(np.full(len(keys[part]), row["shard"], np.int64)),
                        pa.array(docs["first"][part]), pa.array(docs["n"][part]),
                    ], names=["bucket", "key", "doc_id", "turn", "shard", "first", "n"])

    return run


def build_index(shards: DataFrame, folder: str) -> int:
    """Write the index files of the shards; returns the number of buckets."""
    total = shards.agg(F.sum("docs")).first()[0] or 0
    buckets = int(total // BUCKET_KEYS) + 1
    wide = min(shuffle_width(shards.sparkSession), max(1, shards.count()))
    rows = shards.select("name", "shard", "carried").repartition(wide, "name").mapInArrow(
        _tables_reader(folder, buckets), "bucket int, key long, doc_id long, turn long, shard long, first long, n long")

    def write(group: pa.Table) -> pa.Table:
        order = np.lexsort([group.column("first").to_numpy(), group.column("shard").to_numpy()])
        keys = group.column("key").to_numpy().view(np.uint64)[order]
        table = build_hash(keys)
        slots = np.zeros(len(keys), _SLOT)
        at = slots_of(table, keys)
        slots["print"][at] = _prints(keys)
        for c in ("shard", "first", "n"):
            slots[c][at] = group.column(c).to_numpy()[order]
        write_whole(folder, f"index-{group.column('bucket')[0].as_py():06d}.mph", _pack(table, slots))
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})

    written = cut(rows.groupBy("bucket").applyInArrow(write, "bucket int, keys long"))
    assert (written.agg(F.sum("keys")).first()[0] or 0) == total
    return buckets


def lookup(keys: DataFrame, shards: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(doc_id, turn, shard, first, n) of those keys (doc_id, turn) that the index has."""

    def bucket_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
            key = keys_of(ids, batch.column("turn").to_numpy(zero_copy_only=False))
            bucket = (mix(key ^ np.uint64(99)) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket), batch.column("doc_id"), batch.column("turn"), pa.array(key.view(np.int64))], names=["bucket", "doc_id", "turn", "key"])

    def find(group: pa.Table) -> pa.Table:
        table, slots = _unpack(_read_file(folder, f"index-{group.column('bucket')[0].as_py():06d}.mph"))
        key = group.column("key").to_numpy().view(np.uint64)
        at = slots_of(table, key)
        known = at >= 0
        known[known] = slots["print"][at[known]] == _prints(key[known])
        group, at = group.filter(pa.array(known)), at[known]
        return pa.table({
            "doc_id": group.column("doc_id"), "turn": group.column("turn"), "shard": pa.array(slots["shard"][at].astype(np.int64)),
            "first": pa.array(slots["first"][at]), "n": pa.array(slots["n"][at])})

    placed = keys.mapInArrow(bucket_of, "bucket int, doc_id long, turn long, key long")
    return placed.groupBy("bucket").applyInArrow(find, "doc_id long, turn long, shard long, first long, n long")


def read_ids(places: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of places (doc_id, shard, first, n), each read from its shard's range of ids."""

    def read(group: pa.Table) -> pa.Table:
        store, path = open_folder(folder)
        first, n = group.column("first").to_numpy(), group.column("n").to_numpy()
        crc = np.zeros(len(first), np.int64)
        with store.open_input_file(f"{path}/{group.column('name')[0].as_py()}") as src:
            src.seek(src.size() - 8)
            width = int(np.frombuffer(src.read(8), "<i8")[0])
            for i in np.argsort(first, kind="stable"):
                src.seek(len(MAGIC) + int(first[i]) * width)
                ids = np.frombuffer(src.read(int(n[i]) * width), f"<u{width}")
                crc[i] = zlib.crc32(ids.astype("<u4").tobytes())
        return pa.table({
            "doc_id": group.column("doc_id"), "start": pa.array(group.column("start").to_numpy() + first), "n_tokens": pa.array(n),
            "ids_crc32": pa.array(crc), "shard": group.column("shard")})

    with_file = places.join(shards.select("shard", "name", "start"), "shard")
    return with_file.groupBy("shard").applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")


def encode_and_read(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every row of docs (doc_id, text), read back from its shard by key.

    Other columns are not looked at. A null or empty text is the end id alone. Rows with a null doc_id come first;
    of rows with the same doc_id the order is that of their texts' hashes, and equal rows follow one another. An empty
    table writes no file and gives an empty result.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "token-shards")
    shards = write_shards(docs, folder, path, end_id)
    buckets = build_index(shards, folder)
    turns = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    keys = turns.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("turn"))
    return read_ids(lookup(keys, shards, folder, buckets), shards, folder)
