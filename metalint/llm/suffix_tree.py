"""Language-model scores from a probabilistic suffix tree over words.

Symbols are the words that occur ``MIN_COUNT`` times or more in the training texts, the end of a text, and one symbol
for all other words, which are told apart by their base probability. A context is a string of up to ``DEPTH`` symbols;
its next symbols are those that follow it ``MIN_COUNT`` times or more. It becomes a state if its shorter suffix is one
and its next-symbol distribution diverges from that of the suffix by ``DIVERGENCE`` nats. A state gives its next
symbols their share, less a discount, and hands the rest of its mass to its suffix's distribution over the others, so
every distribution sums to one. A token is scored in the state of its longest suffix.

All counts are absolute, so what is learnt grows with the input, and nothing that is learnt comes to the driver or is
broadcast. Texts are cut into chunks, which are kept as places in their list of words. For each depth a chunk sends its
distinct contexts with next symbols and is sent their totals; how often a context occurs is the total of the same string as
context and next symbol at the depth before. Then it sends what its contexts gain and is sent the weights of those that are
states. Both travel as packed arrays of keys, one for each range of keys, and answers are arrays in the same order, so a chunk
makes its keys again and needs none of them back. There are as many ranges as chunks. A next symbol is only counted at a
depth where it was found at the depth before, which its total there cannot be below.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metalint.llm.common import cut, drop_folder, lean_shuffles, open_folder, scratch_folder, shuffle_width, write_whole
from metalint.llm.wordhash import batches_of, hash_words, mix, sums_between

DEPTH = 3
MIN_COUNT = 2
DIVERGENCE = 0.01
DISCOUNT = 0.5
ADDED = 0.1
HELD_OUT = 10
CHUNK_BYTES = 16_000_000
#: The hash that stands for the end of a text among the words.
END = np.uint64(0xE0F0E0F0E0F0E0F1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Tree:
    """Symbols by word hash, and per depth the states with their backing-off weights and next-symbol probabilities.

    names are the words' symbols, 1 and up where none are given; a chunk's tree names a word by its hash.
    """

    words: np.ndarray
    other_share: float
    tokens: int
    distinct: int
    states: list[np.ndarray] = field(default_factory=list)
    backoff: list[np.ndarray] = field(default_factory=list)
    entries: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    names: np.ndarray | None = None

    def symbols(self, tokens: np.ndarray) -> np.ndarray:
        """The symbol of each token, 0 for every word that is none."""
        names = np.arange(1, len(self.words) + 1) if self.names is None else self.names
        at = _find(self.words, tokens)
        return np.where(at >= 0, names[at], names.dtype.type(0)) if len(self.words) else np.zeros(len(tokens), names.dtype)


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and the bounds of the texts."""
    words, bounds = hash_words(texts, lower=True)
    return np.insert(words, bounds[1:], END), bounds + np.arange(len(bounds))


def context_keys(symbols: np.ndarray, bounds: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each depth from 1 the key of the symbols before each token; before a text stand ends."""
    end_symbol = symbols[-1:] if len(symbols) else symbols
    starts = bounds[:-1][np.diff(bounds) > 0]
    inside = np.arange(len(symbols)) - np.repeat(starts, np.diff(bounds)[np.diff(bounds) > 0])
    keys, key = [], np.zeros(len(symbols), np.uint64)
    for back in range(1, depth + 1):
        before = np.empty_like(symbols)
        before[back:] = symbols[:-back]
        before[:back] = end_symbol if len(symbols) else 0
        before = np.where(inside >= back, before, end_symbol if len(symbols) else 0)
        key = mix(key * _STEP + before.astype(np.uint64) + np.uint64(back))
        keys.append(key)
    return keys


def entry_keys(context: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    return mix(context ^ (symbols.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key in a sorted table, -1 where it isn't in it. Keys are looked up in order, as that is much faster."""
    if not len(table):
        return np.full(len(keys), -1)
    order = np.argsort(keys)
    keys = keys[order]
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(table[at] == keys, at, -1)
    return out


def _chunk_name(chunk: int, part: str) -> str:
    return f"{part}-{chunk >> 20:06d}-{chunk & 0xFFFFF:06d}.arrow"


def _read_part(folder: str, chunk: int, part: str) -> pa.Table:
    store, path = open_folder(folder)
    with store.open_input_file(f"{path}/{_chunk_name(chunk, part)}") as src:
        return pa.ipc.open_file(src).read_all().combine_chunks()


def _write_part(folder: str, chunk: int, part: str, table: pa.Table) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    write_whole(folder, _chunk_name(chunk, part), sink.getvalue())


def _chunk_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes a task's rows as chunks and gives each chunk's words with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, made, held, size = pyspark.TaskContext.get().partitionId(), 0, [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, size
            table = pa.Table.from_batches(held).combine_chunks()
            chunk = piece << 20 | made
            tokens, bounds = tokens_of(table.column("text").combine_chunks())
            train = np.repeat([not is_held_out(d) for d in table.column("doc_id").to_pylist()], np.diff(bounds))
            words, at = np.unique(tokens, return_inverse=True)
            counts = np.bincount(at[train], minlength=len(words))
            _write_part(folder, chunk, "docs", pa.table({"doc_id": table.column("doc_id"), "n": pa.array(np.diff(bounds).astype(np.int64))}))
            _write_part(folder, chunk, "tokens", pa.table({"word": pa.array(at.astype(np.int32))}))
            for lo in range(0, len(words), 65536):
                part = slice(lo, lo + 65536)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(words[part]), chunk, np.int64)), pa.array(words[part].view(np.int64)), pa.array(counts[part].astype(np.int64))],
                    names=["chunk", "word", "n"])
            made, held, size = made + 1, [], 0

        for batch in batches_of(batches, 512):
            held.append(batch)
            size += batch.nbytes
            if size >= CHUNK_BYTES:
                yield from close()
        if held:
            yield from close()

    return run


@dataclass(frozen=True)
class Root:
    """What all base probabilities have in common."""

    tokens: int
    distinct: int
    named: int
    others: int

    @property
    def other_share(self) -> float:
        """Of all words that are no symbols."""
        return (self.others + ADDED * (self.distinct + 1 - self.named)) / (self.tokens + ADDED * (self.distinct + 1))

    def logs(self, counts: np.ndarray) -> np.ndarray:
        return np.log((counts + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))


def _words_writer(folder: str) -> Callable[[pa.Table], pa.Table]:
    """Keeps the words that a chunk is sent, in order of their hashes."""

    def run(group: pa.Table) -> pa.Table:
        chunk, key = group.column("chunk")[0].as_py(), group.column("key").to_numpy().view(np.uint64)
        _write_part(folder, chunk, "words", group.drop_columns(["chunk"]).take(pa.array(np.argsort(key))).combine_chunks())
        return pa.table({"chunk": pa.array([chunk], pa.int64())})

    return run


def _pack(values: np.ndarray) -> bytes:
    """Values of 8 bytes, the bytes of like places together."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, size: int, dtype: type) -> np.ndarray:
    raw = pa.decompress(data, decompressed_size=8 * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).view(dtype).reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpack(data, size, np.uint64), dtype=np.uint64)


def _sent(chunk: int, ranges: int, keys: np.ndarray, **values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each range of the keys, which are in order, with the keys and their values packed."""
    edges = np.searchsorted(keys, np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64))
    for i, (lo, hi) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)], strict=True)):
        if lo < hi:
            packed = {name: pa.array([_pack(v[lo:hi])], pa.binary()) for name, v in values.items()}
            yield pa.RecordBatch.from_pydict({
                "range": pa.array([i], pa.int32()), "chunk": pa.array([chunk], pa.int64()), "size": pa.array([hi - lo], pa.int64()),
                "keys": pa.array([_pack_keys(keys[lo:hi])], pa.binary()), **packed})


def _received(group: pa.Table, *names: str) -> list[np.ndarray]:
    """The keys of a range from all chunks, one after another, and their values."""
    sizes = group.column("size").to_pylist()
    keys = [_unpack_keys(d, n) for d, n in zip(group.column("keys").to_pylist(), sizes, strict=True)]
    return [np.concatenate(keys), *(np.concatenate([
        _unpack(d, n, np.float64 if name in ("q", "gain") else np.int64) for d, n in zip(group.column(name).to_pylist(), sizes, strict=True)]) for name in names)]


def _answer(group: pa.Table, values: np.ndarray) -> pa.Table:
    """The values for the keys of a range, packed for each chunk in the order in which it sent them."""
    ends = np.cumsum(group.column("size").to_numpy())
    packed = [_pack(values[lo:hi]) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return group.select(["range", "chunk", "size"]).append_column("data", pa.array(packed, pa.binary()))


def _count(group: pa.Table) -> pa.Table:
    """Totals of next symbols, 0 for those below MIN_COUNT, less than 0 in one chunk for each next symbol: there it is first."""
    keys, n = _received(group, "n")
    _, at = np.unique(keys, return_inverse=True)
    total = np.bincount(at, n).astype(np.int64)
    first = np.zeros(len(total), np.int64)
    first[at] = np.arange(len(at))
    total[total < MIN_COUNT] = 0
    answer = total[at]
    answer[first] *= -1
    return _answer(group, answer)


def _pick(group: pa.Table) -> pa.Table:
    """Backing-off weights of states, not a number for contexts that are none."""
    keys, all_n, *sums = _received(group, "all_n", "n", "k", "q", "gain")
    _, at = np.unique(keys, return_inverse=True)
    n, k, q, gain = (np.bincount(at, x) for x in sums)
    total = np.zeros(len(n), np.int64)
    total[at] = all_n
    p = (n - DISCOUNT * k) / total
    rest_p, rest_q = (1 - np.minimum(x, 1 - 1e-12) for x in (p, q))
    backoff = np.log(rest_p / rest_q)
    return _answer(group, np.where(gain + rest_p * backoff >= DIVERGENCE, backoff, np.nan)[at])


def _answer_writer(folder: str, dtype: type) -> Callable[[pa.Table], pa.Table]:
    """Keeps the answers to all ranges of a chunk's keys in their order, and tells how many there are other than 0."""

    def run(group: pa.Table) -> pa.Table:
        chunk, rows = group.column("chunk")[0].as_py(), sorted(group.to_pylist(), key=lambda r: r["range"])
        values = np.concatenate([_unpack(r["data"], r["size"], dtype) for r in rows])
        _write_part(folder, chunk, "answers", pa.table({"value": pa.array(values)}))
        return pa.table({"n": pa.array([np.count_nonzero(values)], pa.int64())})

    return run


_ANSWER = "range int, chunk long, size long, data binary"


@dataclass
class Layer:
    """What is known of each token of a chunk at one depth.

    context is the key of the symbols before it, all_n how often these occur, n how often the token's symbol follows them (0
    where that is below MIN_COUNT). first are tokens, one for each next symbol that the chunk has first.
    """

    context: np.ndarray
    all_n: np.ndarray
    n: np.ndarray
    first: np.ndarray

    def logs(self) -> np.ndarray:
        """Log of the share of each token's symbol, less the discount, where it is one of the next symbols."""
        return np.log(np.where(self.n > 0, (self.n - DISCOUNT) / np.maximum(self.all_n, 1), 1.0))


class Chunk:
    """The tokens of a chunk, as the files that it has tell them."""

    def __init__(self, folder: str, chunk: int, root: Root):
        self.folder, self.chunk, self.root = folder, chunk, root
        docs, words = _read_part(folder, chunk, "docs"), _read_part(folder, chunk, "words")
        self.word = _read_part(folder, chunk, "tokens").column("word").to_numpy()
        key, self.counts = words.column("key").to_numpy().view(np.uint64), words.column("value").to_numpy()
        self.ids, self.bounds = docs.column("doc_id").combine_chunks(), np.concatenate([[0], np.cumsum(docs.column("n").to_numpy())])
        self.symbols = np.where(self.counts >= MIN_COUNT, key, np.uint64(0))[self.word]
        self.ends = int(self.counts[self.word[self.bounds[1] - 1]])
        # Before a text stands the end. Where that is no symbol, as with a single text to learn from, it has the one of all other
        # words, and how often contexts with that symbol next occur has to be counted.
        unclear = self.ends < MIN_COUNT
        self.unclear = np.flatnonzero(self.before(self.symbols, 0) == 0) if unclear else np.zeros(0, np.int64)

    @cached_property
    def held(self) -> list[bool]:
        return [is_held_out(d) for d in self.ids.to_pylist()]

    def train(self) -> np.ndarray:
        return np.repeat(~np.array(self.held, bool), np.diff(self.bounds))

    def before(self, values: np.ndarray, at_start: int) -> np.ndarray:
        """The value of the token before each token."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.bounds[:-1]] = at_start
        return out

    def base(self) -> np.ndarray:
        return self.root.logs(self.counts)[self.word]

    def _answers(self, part: str, size: int) -> np.ndarray:
        """The values for the keys that the chunk has sent; it has no file where it has sent none."""
        return _read_part(f"{self.folder}/{part}", self.chunk, "answers").column("value").to_numpy() if size else np.zeros(0)

    def asked(self, context: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose next symbols are counted, as they were found at the depth below; the distinct keys; where each token's is.

        After the tokens' own come the contexts of unclear ones.
        """
        here = np.flatnonzero(below)
        keys = entry_keys(context[here], self.symbols[here])
        return here, *np.unique(np.concatenate([keys, context[self.unclear]]), return_inverse=True)

    def found(self, depth: int) -> np.ndarray:
        """How often each token's symbol follows its context of a depth that is done."""
        if depth == 0:
            return np.where(self.counts >= MIN_COUNT, self.counts, self.root.others)[self.word]
        return _read_part(self.folder, self.chunk, f"found{depth}").column("n").to_numpy().astype(np.int64)

    def grow(self, depth: int, context: np.ndarray) -> Layer:
        """A depth from the answers; what tokens need of it later is kept by token, so that keys are not put in order again."""
        below = self.found(depth - 1)
        here, keys, at = self.asked(context, below if depth > 1 else np.ones(len(below), bool))
        value = self._answers(f"counts{depth}", len(keys))
        n = np.zeros(len(below), np.int64)
        n[here] = np.abs(value[at[:len(here)]])
        all_n = self.before(below, self.ends)
        all_n[self.unclear] = np.abs(value[at[len(here):]])
        token = np.full(len(keys), -1)
        token[at[:len(here)]] = here
        _write_part(self.folder, self.chunk, f"found{depth}", pa.table({
            "n": pa.array(n.astype(np.min_scalar_type(n.max())))} | ({"all_n": pa.array(all_n)} if len(self.unclear) else {})))
        return Layer(context, all_n, n, token[(value < 0) & (token >= 0)])

    def layer(self, depth: int, context: np.ndarray) -> Layer:
        """A depth that is done, without the tokens that are first."""
        all_n = (_read_part(self.folder, self.chunk, f"found{depth}").column("all_n").to_numpy() if len(self.unclear)
                 else self.before(self.found(depth - 1), self.ends))
        return Layer(context, all_n, self.found(depth), np.zeros(0, np.int64))

    def maybe(self, layer: Layer, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens whose contexts may be states, as their suffixes are; the distinct contexts; where each token's is."""
        here = np.flatnonzero(live & (layer.all_n >= MIN_COUNT))
        return here, *np.unique(layer.context[here], return_inverse=True)

    def states(self, depth: int, layer: Layer, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """If the context of each token is a state of a depth, and its backing-off weight. live: if its suffix is a state."""
        here, keys, at = self.maybe(layer, live)
        backoff = np.full(len(live), np.nan)
        backoff[here] = self._answers(f"states{depth}", len(keys))[at]
        return ~np.isnan(backoff), backoff


def _each_chunk(rows_of: Callable[[int], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                yield from rows_of(chunk)

    return run


def _symbol_rows(folder: str, root: Root, depth: int, ranges: int) -> Callable[[int], Iterator[pa.RecordBatch]]:
    """Distinct contexts with next symbols of a chunk, by key, and their training counts; texts held out count nothing."""

    def rows_of(number: int) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(folder, number, root)
        context, train = context_keys(chunk.symbols, chunk.bounds, depth)[-1], chunk.train()
        here, keys, at = chunk.asked(context, chunk.found(depth - 1) > 0 if depth > 1 else np.ones(len(train), bool))
        n = np.bincount(at, np.concatenate([train[here], train[chunk.unclear]]), minlength=len(keys))
        yield from _sent(number, ranges, keys, n=n.astype(np.int64))

    return rows_of


def _context_rows(folder: str, root: Root, depth: int, ranges: int) -> Callable[[int], Iterator[pa.RecordBatch]]:
    """Distinct contexts of a chunk that may be states, by key, and what the next symbols add up to that it has first.

    n are the counts of the next symbols, k is how many these are, q their probabilities after the context's suffix, gain how the
    probabilities diverge; all_n is how often the context occurs.
    """

    def rows_of(number: int) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(folder, number, root)
        contexts = context_keys(chunk.symbols, chunk.bounds, depth)
        live = np.ones(len(chunk.symbols), bool)
        if depth == 1:
            logq = np.where(chunk.symbols == 0, np.log(root.other_share), chunk.base())
        else:
            layer = chunk.layer(depth - 1, contexts[-2])
            if depth > 2:
                live = _read_part(folder, number, f"live{depth - 2}").column("live").to_numpy(zero_copy_only=False)
            live, logq = chunk.states(depth - 1, layer, live)[0], layer.logs()
            _write_part(folder, number, f"live{depth - 1}", pa.table({"live": pa.array(live)}))
        layer = chunk.grow(depth, contexts[-1])
        here, contexts, at = chunk.maybe(layer, live)
        all_n = np.zeros(len(contexts), np.int64)
        all_n[at] = layer.all_n[here]
        token = layer.first[live[layer.first]]
        at, n, logq = np.searchsorted(contexts, layer.context[token]), layer.n[token], logq[token]
        p = (n - DISCOUNT) / layer.all_n[token]
        n, k, q, gain = (np.bincount(at, x, minlength=len(contexts)) for x in (n, np.ones(len(n)), np.exp(logq), p * (np.log(p) - logq)))
        yield from _sent(number, ranges, contexts, all_n=all_n, n=n.astype(np.int64), k=k.astype(np.int64), q=q.astype(float), gain=gain.astype(float))

    return rows_of


def _grow_depth(folder: str, chunks: DataFrame, root: Root, depth: int, ranges: int) -> bool:
    """Count the next symbols of one depth, pick its states and answer every chunk; if there was any."""
    sent = "range int, chunk long, size long, keys binary"
    rows = chunks.mapInArrow(_each_chunk(_symbol_rows(folder, root, depth, ranges)), f"{sent}, n binary").groupBy("range").applyInArrow(_count, _ANSWER)
    kept = cut(rows.groupBy("chunk").applyInArrow(_answer_writer(f"{folder}/counts{depth}", np.int64), "n long"))
    if kept.where("n > 0").isEmpty():
        return False
    rows = chunks.mapInArrow(_each_chunk(_context_rows(folder, root, depth, ranges)), f"{sent}, all_n binary, n binary, k binary, q binary, gain binary")
    rows = rows.groupBy("range").applyInArrow(_pick, _ANSWER)
    cut(rows.groupBy("chunk").applyInArrow(_answer_writer(f"{folder}/states{depth}", np.float64), "n long"))
    drop_folder(f"{folder}/counts{depth}")
    return True


def _suffix_probability(tree: Tree, above: np.ndarray, symbols: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Probability of symbols after the suffix state of the last depth, backing off to the root."""
    p = root[symbols].copy()
    if tree.states:
        state, entry = _find(tree.states[-1], above), _find(tree.entries[-1], entry_keys(above, symbols))
        p = np.where(entry >= 0, np.exp(tree.logs[-1][entry]), np.exp(tree.backoff[-1][state]) * p) if len(tree.logs[-1]) else np.exp(tree.backoff[-1][state]) * p
    return p


def _grow(tree: Tree, contexts: np.ndarray, above: np.ndarray, rows: np.ndarray, all_n: np.ndarray, root: np.ndarray) -> None:
    """Add the states of one depth to a tree in memory, from rows (place in contexts, symbol, n) and the counts of the contexts."""
    at, symbol, n = rows
    p = (n - DISCOUNT) / all_n[at]
    q = _suffix_probability(tree, above[at], symbol, root)
    sum_p, sum_q = (np.minimum(np.bincount(at, x, minlength=len(contexts)), 1 - 1e-12) for x in (p, q))
    gain = np.bincount(at, p * np.log(p / q), minlength=len(contexts)) + (1 - sum_p) * np.log((1 - sum_p) / (1 - sum_q))
    kept = gain >= DIVERGENCE
    mine = kept[at]
    keys = entry_keys(contexts[at[mine]], symbol[mine])
    order = np.argsort(keys)
    tree.states.append(contexts[kept])
    tree.backoff.append(np.log((1 - sum_p) / (1 - sum_q))[kept])
    tree.entries.append(keys[order])
    tree.logs.append(np.log(p[mine])[order])


def _keys_of_strings(strings: np.ndarray) -> list[np.ndarray]:
    """Keys of contexts given as rows of symbols, the nearest first, for every depth up to their length."""
    keys, key = [], np.zeros(len(strings), np.uint64)
    for back in range(1, strings.shape[1] + 1):
        key = mix(key * _STEP + strings[:, back - 1].astype(np.uint64) + np.uint64(back))
        keys.append(key)
    return keys


def _backed_off(found: list[tuple[np.ndarray, ...]], symbols: np.ndarray, base: np.ndarray, other_share: float) -> np.ndarray:
    """Natural log probability of each token.

    found has for each depth if its context is a state, the backing-off weight, if its symbol is a next symbol, and that one's log
    probability; base has those of the root for the words themselves.
    """
    out = np.zeros(len(symbols))
    left = np.ones(len(symbols), bool)
    # States are closed under suffixes, so a state of one depth has one of each smaller depth.
    for state, backoff, follows, logs in found[::-1]:
        hit, miss = left & state & follows, left & state & ~follows
        out[hit] += logs[hit]
        out[miss] += backoff[miss]
        left &= ~hit
    out[left] += base[left]
    # A hit of the symbol for all other words still has to name the word.
    unnamed = ~left & (symbols == 0)
    out[unnamed] += base[unnamed] - np.log(other_share)
    return out


def log_probabilities(tree: Tree, tokens: np.ndarray, bounds: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Natural log probability of each token by a tree in memory; base has those of the root for the words themselves."""
    symbols, found = tree.symbols(tokens), []
    keys = context_keys(symbols, bounds, len(tree.states))
    for states, backoff, entries, logs, key in zip(tree.states, tree.backoff, tree.entries, tree.logs, keys, strict=True):
        state, entry = _find(states, key), _find(entries, entry_keys(key, symbols))
        found.append((state >= 0, np.append(backoff, 0.0)[state], entry >= 0, np.append(logs, 0.0)[entry]))
    return _backed_off(found, symbols, base, tree.other_share)


def _scorer(folder: str, root: Root, depth: int) -> Callable[[int], Iterator[pa.RecordBatch]]:
    def scored(number: int) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(folder, number, root)
        found, live = [], np.ones(len(chunk.symbols), bool)
        for d, context in enumerate(context_keys(chunk.symbols, chunk.bounds, depth), 1):
            layer = chunk.layer(d, context)
            live, backoff = chunk.states(d, layer, live)
            found.append((live, backoff, layer.n > 0, layer.logs()))
        base = chunk.base()
        score = _backed_off(found, chunk.symbols, base, root.other_share)
        yield pa.RecordBatch.from_pydict({
            "doc_id": chunk.ids, "held_out": pa.array(chunk.held, pa.bool_()),
            "n_tokens": pa.array(np.diff(chunk.bounds).astype(np.int64)), "n_known": pa.array(sums_between((chunk.counts > 0)[chunk.word], chunk.bounds)),
            "train_tokens": pa.array(np.full(len(chunk.ids), root.tokens, np.int64)),
            "base_score": pa.array(sums_between(base, chunk.bounds) / np.log(10)), "score": pa.array(sums_between(score, chunk.bounds) / np.log(10))})

    return scored


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text).

    Other columns are not looked at. A null or empty text is its end alone. Rows with the same doc_id are all held out
    or all learnt from, a null id is held out. Repeated rows count as often as they occur. With nothing to learn from
    all tokens have the same base probability. An empty table writes nothing and gives an empty result.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark, "suffix-tree")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with lean_shuffles(spark):
        return _scored(rows, folder)


def _scored(rows: DataFrame, folder: str) -> DataFrame:
    spark = rows.sparkSession
    by_word = Window.partitionBy("word")
    counted = rows.mapInArrow(_chunk_writer(folder), "chunk long, word long, n long")
    counted = counted.withColumn("c", F.sum("n").over(by_word)).withColumn("turn", F.row_number().over(by_word.orderBy("chunk")))
    # A word has one row per chunk; Parquet keeps these much smaller than a checkpoint would.
    counted.write.option("compression", "zstd").parquet(f"{folder}/words")
    counted = spark.read.parquet(f"{folder}/words")
    many = F.col("c") >= MIN_COUNT
    tokens, distinct, named, n_named = counted.where("turn = 1 and c > 0").agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(many, F.col("c"))), F.lit(0)), F.count(F.when(many, 1))).first()
    root = Root(tokens, distinct, n_named, tokens - named)
    words = counted.select("chunk", F.col("word").alias("key"), F.col("c").alias("value"))
    chunks = cut(cut(words.groupBy("chunk").applyInArrow(_words_writer(folder), "chunk long")).repartition(shuffle_width(spark), "chunk"))
    ranges = max(1, chunks.count())
    drop_folder(f"{folder}/words")
    depth = 0
    while depth < DEPTH and _grow_depth(folder, chunks, root, depth + 1, ranges):
        depth += 1
    return chunks.mapInArrow(
        _each_chunk(_scorer(folder, root, depth)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
