"""Token counts by the whole-token shortcut.

Which entries of the vocabulary encode alone as one token is proved before the job, entry by entry; a pre-token among them counts one
without a merge, and only the others are merged.  No pre-token reaches from a visible character into white space, so a text is cut
there, and a task remembers the count of the cuts it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edictal.llm.word_table import text_steps, tokenizer

REMEMBERED = 400_000
# A cut ends before white space that follows a visible character.  Texts with any other white space are counted as one cut.
CUT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
OTHER_WHITE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")


def whole_tokens(path: str) -> frozenset[str]:
    """The entries of the vocabulary that the model, given them alone, encodes as just themselves."""
    tok = tokenizer(path)
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    return frozenset(s for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in added and [t.id for t in tok.model.tokenize(s)] == [i])


class Counter:
    def __init__(self, path: str, whole: frozenset[str], remembered: int = REMEMBERED):
        tok = tokenizer(path)
        if tok.normalizer is not None or tok.pre_tokenizer is None:
            raise ValueError("the shortcut needs a vocabulary that splits texts without normalising them")
        self.split, self.merge, self.whole, self.seen, self.remembered = tok.pre_tokenizer.pre_tokenize_str, tok.model.tokenize, whole, {}, remembered
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.marks = [s[:2] for s in special]

    def cut(self, piece: str) -> int:
        whole, n = self.whole, 0
        for pre, _ in self.split(piece):
            n += 1 if pre in whole else len(self.merge(pre))
        return n

    def plain(self, text: str) -> int:
        if not text:
            return 0
        if not text.isascii() and OTHER_WHITE.search(text) or text.isascii() and any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f"):
            return self.cut(text)
        cuts, seen = CUT.findall(text), self.seen
        try:
            return sum([seen[c] for c in cuts])
        except KeyError:
            for c in cuts:
                if c not in seen:
                    seen[c] = self.cut(c)
            return sum([seen[c] for c in cuts])

    def count(self, text: str) -> int:
        if len(self.seen) > self.remembered:
            self.seen = {}
        if any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; null counts as the empty text, which has no tokens.

    A special string inside a text is one token, as the library has it by default.  Rows are never merged, and other columns are not read.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters[path] = Counter(path, whole.value)
        counter = _counters[path]
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for i, _, texts in text_steps(batch.column("text"), 1 << 20):
                n[i : i + len(texts)] = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n)], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
