from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from metalint.llm import token_shards, warc
from metalint.llm.common import open_folder, scratch_folder

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(texts):
    return [np.array(e.ids + [2], "<u4") for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_round_trip(make_docs, odd_rows):
    rows = odd_rows + [(400, "<|endoftext|> x<|startoftext|>y z w\x1cv İΣς é", "s0"), (401, "Don't\r\nstop\x0bnow\x0c", "s0")]
    got = sorted(token_shards.encode_and_read(make_docs(rows), PATH).collect(), key=lambda r: r["start"])
    want = Counter((d, len(i), zlib.crc32(i.tobytes())) for (d, *_), i in zip(rows, ids_of(t for _, t, _ in rows), strict=True))
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    assert token_shards.encode_and_read(make_docs([]), PATH).collect() == []


def test_lookup_of_unknown_keys(spark, make_docs, odd_rows):
    folder = scratch_folder(spark, "test-shards")
    shards = token_shards.write_shards(make_docs(odd_rows), folder, PATH)
    buckets = token_shards.build_index(shards, folder)
    asked = spark.createDataFrame([(104, 0), (104, 2), (104, 3), (999_999, 0), (None, 1), (None, 2)], "doc_id long, turn long")
    assert {(r["doc_id"], r["turn"]) for r in token_shards.lookup(asked, shards, folder, buckets).collect()} == {(104, 0), (104, 2), (None, 1)}
    store, path = open_folder(folder)
    assert all(not f.base_name.startswith(".") for f in store.get_file_info(__import__("pyarrow").fs.FileSelector(path)))


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, 2**63), max_size=400))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    table, slots = token_shards._unpack(token_shards._pack(token_shards.build_hash(keys), np.zeros(len(keys), token_shards._SLOT)))
    assert sorted(token_shards.slots_of(table, keys)) == list(range(len(keys))) and len(slots) == len(keys)


def test_words_forgotten_and_met_again(monkeypatch):
    """Few words are remembered, so generations change within a call and from call to call; marks occur in words too."""
    monkeypatch.setattr(token_shards, "_MEMO", 60)
    code = token_shards.WordEncoder(PATH, 2)
    assert code.model is not None and code.mark is not None
    assert not token_shards.letters_go_whole(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    rng = random.Random(4)
    for _ in range(20):
        words = [rng.choice(["Plain", "plain", "a|b", "|", "don't", "Éß", "x9", "\xa0", "ﬁ", "THE", "zq" * rng.randint(1, 9)]) + rng.choice(["", "", "é", "!"]) for _ in range(90)]
        texts = [" ".join(words[i:i + 9]) for i in range(0, 90, 9)]
        assert [np.frombuffer(x, "<u2").tolist() for x in code.encode_all(texts)] == [i.tolist() for i in ids_of(texts)]


def test_many_words_stay_known(monkeypatch):
    """700,000 words are encoded once each, as long as they are met again, and a word takes some 30 bytes."""
    code = token_shards.WordEncoder(PATH, 2)
    asked, plain = [], code.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(len(texts))
            return plain.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    code.tokenizer = Counting()
    texts = [" ".join(f"{i:x}." for i in range(lo, lo + 70_000)) for lo in range(0, 700_000, 70_000)]
    once = [code.encode_all([t]) for t in texts]
    first = len(asked)
    assert [code.encode_all([t]) for t in texts] == once and len(asked) == first
    memo = code.memo
    held = memo.ids.nbytes + sum(c.nbytes for run in (memo.long, memo.short) for c in run.columns)
    assert held < 50 * 700_000
    monkeypatch.setattr(token_shards, "_MEMO", 100_000)
    assert [code.encode_all([t]) for t in texts] == once and len(memo.long) + len(memo.short) <= 170_000


def test_any_text_by_words():
    code = token_shards.WordEncoder(PATH, 2)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abC'sdt Éß日́ \t\n\r\x0b\x1c  İΣ09.,<|>") for _ in range(60)) for _ in range(300)]
    assert code.by_word and [np.frombuffer(x, "<u2").tolist() for x in code.encode_all(texts)] == [i.tolist() for i in ids_of(texts)]


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, revisit int")


def test_archives(spark):
    long = "é" * 700
    rows = [(i, f"http://www.h{i % 5}.example.com/p?q={i % 3}", f"<p>{i}</p>") for i in range(60)]
    rows += [(100 + i, "https://hot.example.org/", long) for i in range(40)] + [(139, "https://hot.example.org/", long)]
    rows += [(200, None, None), (201, "x y\r\nz", ""), (202, "http://a", "short"), (203, "http://a", "short"), (None, "http://n", long), (None, "http://m", "only" * 400)]
    rows += [(204, "http://big", "ab" * 2_000_000)]
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_and_read(pages_of(spark, rows)).collect())
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = html == long and i != 139
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 139 if revisit else None)] += 1
    assert got == want
    assert warc.archive_and_read(pages_of(spark, [])).collect() == []


def test_index_is_ordered(spark, monkeypatch):
    """Many small runs, a low fan-in and short ranges: several merge passes, one hot url."""
    folder = scratch_folder(spark, "test-warc")
    rows = [(i, f"http://h{i * 7 % 11}.example.com/{i % 13}" if i % 3 else "http://hot.example.com/", str(i)) for i in range(3000)]
    runs = warc.write_archives(pages_of(spark, rows), folder, run_lines=350)
    assert runs.count() >= 9
    merged = warc.merge_runs(runs, folder, range_lines=400, fan_in=2)
    assert merged.count() > 3 and merged.agg(F.sum("lines")).first()[0] == 3000
    history = warc.capture_history(merged, folder).collect()
    by_part = {}
    for r in history:
        by_part.setdefault(r["part"], []).append(r["line"])
    lines = [x for p in sorted(by_part) for x in by_part[p]]
    assert lines == sorted(lines) and len(lines) == 3000 and max(map(len, by_part.values())) < 1500


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=3), max_size=20), max_size=9))
def test_loser_tree(streams):
    streams = [sorted(s) for s in streams]
    assert list(warc.loser_tree([iter(s) for s in streams])) == sorted(x for s in streams for x in s)


def test_record_format():
    member, stamp = warc.warc_record(7, "http://a/b c", b"hello", None, False)
    fields, payload = warc.read_record(member)
    assert payload == b"hello" and stamp == "20240101000007" and fields["WARC-Target-URI"] == "http://a/b%20c"
    assert base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex() == hashlib.sha1(b"hello").hexdigest()
