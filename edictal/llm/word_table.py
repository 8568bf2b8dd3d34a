"""BPE encoding and decoding through a table of distinct words.

The vocabulary drops white space, so no token reaches over it: a text is the sequence of its words, and each word has its ids whatever
stands around it.  Spark splits all texts and counts the distinct words.  The most frequent ones, up to ``TABLE_WORDS``, are encoded
once each and looked up in a broadcast of bounded size.  A word beyond them is rare: it is encoded where it stands and remembered by the
worker as long as it is used.  Decoding looks every id's piece up in a vocabulary of fixed size.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from edictal.llm.common import fill, flat, kept, steps
from edictal.session import stage

# Bounds of the broadcast table: so many words of so many bytes at most.
TABLE_WORDS = 1 << 18
WORD_BYTES = 48
# Words that a Python worker remembers in each of two generations; those that were not used during one are forgotten.
REMEMBERED = 700_000
# The same beside the broadcast table, which holds the frequent words.
REMEMBERED_BESIDE = 100_000
# Words that the library cuts as one text.
LEARNED = 4096
# Words whose ids show whether that gives what the library gives for each alone.
SAMPLES = ("Año.", "ciónes%%%", "it's", "ﬁn", "日本語", "e\u0301", "x\u00adz", "1,234.5", "🙂🙂!", "d'A-b_c", "\u200d", "ÇŞİ", "…", "a\u0300\u0301")
# Fixed value: the characters that the vocabulary's white-space pattern matches (Unicode White_Space).
WHITE = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Python's split() takes these for white space too; texts that hold them go through the library whole.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _tokenizers:
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _tokenizers[path] = tok
    return _tokenizers[path]


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Ids of whole texts, word by word.  ``known`` gives the ids of frequent words as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, known: dict[str, bytes] | None = None, remembered: int = REMEMBERED):
        self.tok, self.known, self.ids, self.old, self.remembered = tokenizer(path), known or {}, dict(known or {}), {}, remembered
        # A text that holds the beginning of a special token is left to the library.
        self.marks = tuple({t.content[:2] for t in self.tok.get_added_tokens_decoder().values() if t.content}) + SEPARATORS

        # A word of plain letters, whatever their case, is one pre-token, and so is a stop or comma after it: the model gets the lower-cased
        # letters alone.  Only where the library agrees on samples.
        self.ends = {c: self.whole(c) for c in ".,"}
        self.cuts = False
        self.plain = all(self.letters(w[:-1].lower()) + self.ends[w[-1]] == self.whole(w) for w in ("Word,", "a.", "UNSEPARABLE,", "xqzjkv."))
        # Words of any kind are normalised and cut apart from the model's part, only where the library agrees on samples.
        if self.tok.normalizer is not None and self.tok.pre_tokenizer is not None and self.tok.post_processor is None:
            self.cuts = self.apart(list(SAMPLES)) == [self.whole(w) for w in SAMPLES]

    def whole(self, text: str) -> bytes:
        return pack_ids(self.tok.encode(text, add_special_tokens=False).ids)

    def letters(self, word: str) -> bytes:
        return pack_ids([t.id for t in self.tok.model.tokenize(word)])

    def apart(self, words: list[str]) -> list[bytes]:
        """Ids of every word.  The library normalises and cuts many words as one text; the model gets every distinct pre-token once."""
        out, made = [], {}
        for at in range(0, len(words), LEARNED):
            text = self.tok.normalizer.normalize_str(" ".join(words[at : at + LEARNED]))
            cut = [self.tok.pre_tokenizer.pre_tokenize_str(text)] if self.spaced(text, len(words[at : at + LEARNED])) else []
            if not cut:
                out += map(self.whole, words[at : at + LEARNED])
                continue
            ends = [i for i, c in enumerate(text) if c == " "] + [len(text)]
            parts: list[list[bytes]] = [[] for _ in ends]
            k = 0
            for piece, (begin, _) in cut[0]:
                while begin >= ends[k]:
                    k += 1
                ids = made.get(piece)
                if ids is None:
                    ids = made[piece] = self.letters(piece)
                parts[k].append(ids)
            out += map(b"".join, parts)
        return out

    @staticmethod
    def spaced(text: str, n: int) -> bool:
        """Whether normalising kept the spaces between words, and made no new ones."""
        return text.count(" ") == n - 1

    def learn(self, missing: list[str]) -> None:
        """Ids of words that are not known: from the older generation, else from the library."""
        ids, old, ends = self.ids, self.old, self.ends
        other = []
        for word in missing:
            found = old.get(word)
            if found is not None:
                ids[word] = found
                continue
            base = word[:-1] if word[-1] in ends else word
            if not (self.plain and base.isascii() and base.isalpha()):
                other.append(word)
                continue
            core = base.lower()
            found = ids.get(core)
            if found is None:
                found = ids[core] = old.get(core) or self.letters(core)
            ids[word] = found if base is word else found + ends[word[-1]]
        ids.update(zip(other, self.apart(other) if self.cuts else map(self.whole, other), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.ids) - len(self.known) > self.remembered:
            # What was used since the last time is kept one more time.
            self.old, self.ids = self.ids, dict(self.known)
        split: list[list[str] | None] = [None if any(m in t for m in self.marks) else t.split() for t in texts]
        ids = self.ids
        self.learn(list(set(chain.from_iterable(filter(None, split))).difference(ids)))
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self.whole(text))
            else:
                out.append(b"".join(map(ids.__getitem__, words)))
        return out


def text_steps(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a text column with their texts, null as the empty text."""
    column = fill(column)
    _, offsets = flat(column)
    for i, j in steps(offsets, size):
        yield i, j, column.slice(i, j - i).to_pylist()


def _id_lists(encoded: list[bytes]) -> pa.Array:
    lengths = np.array([len(e) // 4 for e in encoded], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def frequent_words(docs: DataFrame, text_col: str, table_words: int) -> DataFrame:
    """The most frequent distinct words, no more than ``table_words``.

    Words are taken by classes of their count, the most frequent class first, as long as a class fits whole; there are at most a few
    thousand classes at any size.  A word that occurs once stays out: it is encoded once anyway, where it stands.
    """
    words = docs.select(F.explode(F.split(F.col(text_col).cast("string"), WHITE)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = words.filter((F.col("word") != "") & (F.octet_length("word") <= WORD_BYTES) & (F.col("n") > 1))
    words = stage(words.select("word", F.floor(F.log2("n") * 64).cast("int").alias("class")))
    least, total = None, 0
    for count_class, n in sorted(map(tuple, words.groupBy("class").count().collect()), reverse=True):
        total += n
        if total > table_words:
            break
        least = count_class
    return words.filter(F.lit(False) if least is None else F.col("class") >= least)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) with every distinct word encoded once; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_steps(batch.column("word"), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(WordEncoder(path).encode(texts), pa.binary())], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids binary")


def word_table(docs: DataFrame, path: str, text_col: str, table_words: int) -> dict[str, bytes]:
    """The broadcast side: at most ``table_words`` words of ``WORD_BYTES``."""
    got = encode_words(frequent_words(docs, text_col, table_words), path).toArrow()
    return dict(zip(got.column("word").to_pylist(), got.column("ids").to_pylist(), strict=True))


def encoder(key: str, make: Callable[[], WordEncoder]) -> WordEncoder:
    """One encoder a worker process, which goes on remembering rare words from task to task until another operator uses the worker."""
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS, decoded: bool = False) -> DataFrame:
    """(id, ids) of every row: the ids of its whole text without special tokens; null and empty texts have none.

    Special strings inside a text get the ids that the library gives them.  Rows are never merged, so repeated ids and texts stay; an
    empty table gives an empty result, and other columns of ``docs`` are not read.  ``decoded`` adds what ``decode`` adds, in the same
    worker: ids then go through one Python process a task instead of two.
    """
    spark = docs.sparkSession
    if decoded:
        check_joined(path)
    known, key = spark.sparkContext.broadcast(word_table(docs, path, text_col, table_words)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = encoder(key, lambda: WordEncoder(path, known.value, REMEMBERED_BESIDE)), pieces(path) if decoded else None
        for batch in batches:
            for i, j, texts in text_steps(batch.column("text"), (1 if decoded else 2) << 20):
                found = pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), _id_lists(enc.encode(texts))], names=["id", "ids"])
                yield from decoded_steps(found, *names) if decoded else [found]

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>" + DECODED * decoded)


def pieces(path: str) -> tuple[pa.Array, pa.Array]:
    """The piece of every id, special tokens included, and its decimal number."""
    tok = tokenizer(path)
    names = pa.array([tok.id_to_token(i) for i in range(tok.get_vocab_size(with_added_tokens=True))], pa.string())
    return names, pc.cast(pa.array(np.arange(len(names))), pa.string())


def joined(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """Every list of ids as the names of its ids, joined by one space: an id-to-name join of a whole batch."""
    at = ids.offsets.to_numpy().astype(np.int64)
    found = names.take(pc.cast(ids.values.slice(int(at[0]), int(at[-1] - at[0])), pa.int64()))
    lists = pa.LargeListArray.from_arrays(pa.array(at - at[0]), pc.cast(found, pa.large_string()))
    return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


DECODED = ", decoded string, written string"


def check_joined(path: str) -> None:
    if tokenizer(path).decoder is not None:
        raise ValueError("only vocabularies without a decoder are decoded by joining pieces")


def decoded_steps(batch: pa.RecordBatch, piece: pa.Array, number: pa.Array) -> Iterator[pa.RecordBatch]:
    """id and ids of a batch with their decoded texts and written numbers, so many ids at a time."""
    ids = batch.column("ids")
    at = ids.offsets.to_numpy().astype(np.int64)
    for i, j in steps(at - at[0], 1 << 18):
        part = ids.slice(i, j - i)
        part = pa.ListArray.from_arrays(pa.array((at[i : j + 1] - at[i]).astype(np.int32)), ids.values.slice(int(at[i]), int(at[j] - at[i])))
        yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), part, joined(part, piece), joined(part, number)], names=["id", "ids", "decoded", "written"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` as the library gives it for a vocabulary without a decoder, and ``written``, the decimal ids.

    A vocabulary without a decoder joins pieces by one space; special tokens stay.  Null ids count as none.
    """
    check_joined(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pieces(path)
        for batch in batches:
            yield from decoded_steps(batch, *names)

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>" + DECODED)
