"""Token counts: a broadcast table of frequent pre-token lengths, then worker caches; pre-tokens are never shuffled."""

from __future__ import annotations

import functools
import json
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import ChunkTable, chunks_of, table, text_of

#: Lengths in the broadcast table; about 1 MB, whatever the size of the corpus.
FREQUENT = 16_384
#: Rows that one task gives to the count of frequent pre-tokens, and the counters that it holds meanwhile.
TASK_SUMMARY, TASK_COUNTERS = 1_024, 200_000


@functools.cache
def tokenizer(path: str):
    """The tokenizer of one file, loaded once a process; one thread, as Spark already uses all cores."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Words whose ids a worker process keeps.
WORDS_KEPT = 800_000
#: Chunks that are a word of letters, which lower-casing keeps single and composed, and marks that no contraction begins with.
_MARKS = ".,!?%&$#*;:"
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def word_and_marks(chunk: str) -> tuple[str, str] | None:
    """The word in lower case and the marks after it, of a chunk that is made of these; else None."""
    word = chunk.rstrip(_MARKS)
    return (word.lower(), chunk[len(word) :]) if word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word)) else None


#: Texts that lower-casing changes letter by letter.
_SAFE = re.compile(r"[\x00-\x7FÀ-ÖØ-öø-ÿ]*")


class Merges:
    """The merges of a BPE over bytes with word ends, done on very many words at a time.

    A round merges, in every word, the pair of least rank wherever it stands; words without such a pair are done. That gives
    the library's ids if no merge makes a pair of lesser rank, which `of` proves from the table before it is used.
    """

    NONE = np.int32(2**31 - 1)
    BITS = 18

    def __init__(self, first: np.ndarray, last: np.ndarray, pairs: np.ndarray, made: np.ndarray):
        """`first` and `last`: a byte's token inside and at the end of a word; `pairs`: left * 2**16 + right by rank; `made`: the tokens that they make."""
        self.first, self.last, self.made = first, last, made
        self.keys = np.full(1 << self.BITS, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.BITS, self.NONE, np.int32)
        for rank, (key, at) in enumerate(zip(pairs.tolist(), self._slot(pairs).tolist(), strict=True)):
            while self.keys[at] != 0xFFFFFFFF:
                at = (at + 1) % (1 << self.BITS)
            self.keys[at], self.ranks[at] = key, rank

    @classmethod
    def of(cls, tokenizer) -> Merges | None:
        """None for a tokenizer that is made otherwise; the library is then used."""
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(tokenizer.to_str())
        model, cut = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[-1]
        suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab")
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not suffix or not plain or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or max(vocab.values()) >= 0xFFFF:
            return None
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {b: level.pre_tokenize_str(c)[0][0][k] for c in [*map(chr, range(0x80)), *map(chr, range(0x80, 0x100))] for k, b in enumerate(c.encode())}
        if any(s + e not in vocab for s in signs.values() for e in ("", suffix)):
            return None
        first, last = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
        for b, s in signs.items():
            first[b], last[b] = vocab[s], vocab[s + suffix]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        made_at: dict[str, int] = {}
        for rank, (a, b) in enumerate(merges):
            if made_at.get(a, -1) >= rank or made_at.get(b, -1) >= rank or a + b not in vocab:
                return None
            made_at.setdefault(a + b, rank)
        if len(set(merges)) < len(merges) or any(made_at.get(x, -1) > rank for rank, m in enumerate(merges) for x in m):
            return None
        pairs = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        return cls(first, last, pairs, np.array([vocab[a + b] for a, b in merges], np.uint32))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << np.uint32(16) | right
        at = self._slot(key)
        found = self.keys[at]
        rank = np.where(found == key, self.ranks[at], self.NONE)
        open_ = np.flatnonzero((found != key) & (found != 0xFFFFFFFF))
        at, key = at[open_], key[open_]
        while len(open_):
            at = (at + np.uint32(1)) % np.uint32(1 << self.BITS)
            found = self.keys[at]
            hit = found == key
            rank[open_[hit]] = self.ranks[at[hit]]
            rest = ~hit & (found != 0xFFFFFFFF)
            open_, at, key = open_[rest], at[rest], key[rest]
        return rank

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, sizes, ids): words by number as they were done, the number of ids of each, and their ids joined. Words are not empty and have no blanks."""
        raw = np.frombuffer(" ".join(words).encode(), np.uint8)
        blank = raw == 32
        sizes = np.diff(np.r_[-1, np.flatnonzero(blank), len(raw)]) - 1
        raw = raw[~blank]
        which, out = np.arange(len(words)), []
        ends = np.cumsum(sizes) - 1
        last = np.zeros(len(raw), bool)
        last[ends] = True
        t = self.first[raw]
        t[ends] = self.last[raw[ends]]
        r = np.full(len(t), self.NONE)
        inner = np.flatnonzero(~last)
        r[inner] = self._rank(t[inner], t[inner + 1])
        while len(which):
            least = np.minimum.reduceat(r, np.cumsum(sizes) - sizes)
            if (done := least == self.NONE).any():
                of = np.repeat(done, sizes)
                out.append((which[done], sizes[done], t[of]))
                which, sizes, least, t, r, last = which[~done], sizes[~done], least[~done], t[~of], r[~of], last[~of]
                if not len(which):
                    break
            hit = r == np.repeat(least, sizes)
            hit[1:] &= ~hit[:-1]  # of a run of equal pairs the next one waits for a round
            sizes = sizes - np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
            at = np.flatnonzero(hit)
            t[at] = self.made[r[at]]
            last[at] = last[at + 1]
            stays = np.ones(len(t), bool)
            stays[at + 1] = False
            t, r, last = t[stays], r[stays], last[stays]
            at -= np.arange(len(at))
            r[at[last[at]]] = self.NONE
            before = at[at > 0] - 1
            new = np.concatenate([at[~last[at]], before[~last[before]]])
            r[new] = self._rank(t[new], t[new + 1])
        return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out, strict=True) if out else ((),) * 3))


class ChunkEncoder:
    """Ids of chunks as packed unsigned numbers of `unit`.

    The pre-tokens of word_bpe_49k never span blanks, so a text's ids are those of its chunks in order. Most chunks are a word
    and marks, two pre-tokens; the ids of words and marks are kept, and new words are merged together (`Merges`). Every other
    chunk is encoded by itself.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.unit = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.merges = Merges.of(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def chunks(self, text: str) -> list[str]:
        """Chunks whose ids in order are those of the text. Where it is safe they are in lower case, so that there are fewer different ones."""
        if (text.isascii() or _SAFE.fullmatch(text)) and not any(t in text for t in self.added):
            text = text.lower()
        return chunks_of(text)

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.unit).tobytes()

    def _direct(self, chunks: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        if not self.merges:
            self.words.update(zip(words, self._direct(words), strict=True))
            return
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            which, sizes, ids = self.merges.ids(part)
            flat, a = ids.astype(self.unit).tobytes(), 0
            for k, b in zip(which.tolist(), (np.cumsum(sizes) * self.unit.itemsize).tolist(), strict=True):
                self.words[part[k]] = flat[a:b]
                a = b

    def encode(self, chunks: list[str]) -> list[bytes]:
        parts = [(c.lower(), "") if c.isascii() and c.isalpha() else word_and_marks(c) for c in chunks]
        wanted = {p[0] for p in parts if p}
        new = wanted.difference(self.words)
        if len(self.words) + len(new) > WORDS_KEPT:
            self.words.clear()
            new = wanted  # those known before have gone too
        self._learn(list(new))
        if marks := list({p[1] for p in parts if p}.difference(self.marks)):
            self.marks.update(zip(marks, self._direct(marks), strict=True))
        rest = iter(self._direct([c for c, p in zip(chunks, parts, strict=True) if not p]))
        return [self.words[p[0]] + self.marks[p[1]] if p else next(rest) for p in parts]


@functools.cache
def encoder(path: str) -> ChunkEncoder:
    """One a process, so that what it has learnt serves all tasks there."""
    return ChunkEncoder(path)


def _summaries(batches):
    """Misra-Gries counters over all texts of a task: what is frequent survives every thinning."""
    counts: Counter = Counter()
    for b in batches:
        for text in b.column(0).to_pylist():
            counts.update(chunks_of(text))
        if len(counts) > TASK_COUNTERS:
            floor = sorted(counts.values(), reverse=True)[TASK_COUNTERS // 4]
            counts = Counter({k: v - floor for k, v in counts.items() if v > floor})
    counts.pop("", None)
    top = counts.most_common(TASK_SUMMARY)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([v for _, v in top], pa.int64())], ["chunk", "n"])


def frequent_lengths(docs: DataFrame, path: str, size: int = FREQUENT) -> dict[str, int]:
    """The `size` pre-tokens found most often over all documents, with their token counts.

    Each task sends a summary of fixed size; those are added up by pre-token. The table only saves time: what it lacks is encoded.
    """
    tops = docs.select("text").mapInArrow(_summaries, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    chunks = [r.chunk for r in tops.orderBy(F.desc("n"), "chunk").limit(size).select("chunk").collect()]
    own = encoder(path)
    return {"": 0} | {c: len(ids) // own.unit.itemsize for c, ids in zip(chunks, own.encode(chunks), strict=True)}


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: `id_col`, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > `limit`).

    Null text counts as empty: 0 bytes, 0 tokens. Rows with equal or null ids each give a row; other columns are left out;
    an empty table gives an empty result. Whole texts are counted, however long.
    """
    spark = docs.sparkSession
    rows = text_of(docs.withColumnRenamed(id_col, "doc_id") if id_col != "doc_id" else docs, "doc_id", text=text_col)
    sent = spark.sparkContext.broadcast(frequent_lengths(rows, path))

    def count(batches):
        own = encoder(path)
        lengths = ChunkTable(lambda new: [len(x) // own.unit.itemsize for x in own.encode(new)], sent.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = [*map(chunks_of, texts)]
            lengths.learn(lists)
            n = [sum(map(lengths.__getitem__, x)) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("doc_id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
