"""Token counts by trie-shared dynamic programming over a unigram piece vocabulary.

The distinct pre-tokens of a task are taken in sorted order, which is the order in which a depth-first walk meets the
ends of their trie: what a pre-token shares with the one before is one path, whose forward scores are computed once.
The count at each end is stored, and documents add up the counts of their pre-tokens. Nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = "▁"
#: Counts of so many pre-tokens are kept from batch to batch of a task.
KEPT = 300_000


@dataclass
class Pieces:
    """Scores of pieces; a character in none of them costs `unknown` for each of its UTF-8 bytes, one token a byte."""

    scores: dict[str, float]
    unknown: float = -25.0
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.scores), default=1)

    @classmethod
    def load(cls, path: str) -> Pieces:
        """The pieces of a sentencepiece file. Its scores are merge ranks, so Zipf's law by rank stands in for logs of
        probabilities; control and byte pieces are left out."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i))]
        return cls({p.id_to_piece(i): -math.log(n + 10.0) for n, i in enumerate(usual)})

    def counts(self, pretokens: Iterable[str]) -> dict[str, int]:
        """Tokens on the best path of each pre-token; of equal scores the path whose last piece is shortest.

        best[i] and tokens[i] are the forward score and the tokens of the first i characters of the current path.
        """
        out: dict[str, int] = {}
        best, tokens, before = [0.0], [0], ""
        get, longest = self.scores.get, self.longest
        for word in sorted(set(pretokens)):
            shared = len(commonprefix((before, word)))
            del best[shared + 1 :], tokens[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                top, n = -math.inf, 0
                for j in range(i - 1, max(0, i - longest) - 1, -1):
                    s = get(word[j:i])
                    if s is not None and best[j] + s > top:
                        top, n = best[j] + s, tokens[j] + 1
                if word[i - 1] not in self.scores:
                    size = len(word[i - 1].encode("utf-8", "surrogatepass"))
                    if best[i - 1] + self.unknown * size > top:
                        top, n = best[i - 1] + self.unknown * size, tokens[i - 1] + size
                best.append(top)
                tokens.append(n)
            out[word] = tokens[-1]
            before = word
        return out


def token_counts(docs: DataFrame, pieces: Pieces, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every row; a pre-token is a word behind the mark of a space.

    Null and empty texts have none of either. A text without spaces is one pre-token, however long. Repeated rows are
    counted each. No rows: no rows. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 500):
                s = b.slice(at, 500)
                words = [WORD.findall(t or "") for t in s.column("text").to_pylist()]
                new = {w for ws in words for w in ws if w not in known}
                if len(known) + len(new) > KEPT:
                    known, new = {}, {w for ws in words for w in ws}
                known.update((w[1:], n) for w, n in shared.value.counts(SPACE + w for w in new).items())
                yield pa.RecordBatch.from_arrays(
                    [
                        s.column("id"),
                        pa.array([len(ws) for ws in words], pa.int64()),
                        pa.array([sum(map(known.__getitem__, ws)) for ws in words], pa.int64()),
                    ],
                    ["doc_id", "n_words", "n_tokens"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")
