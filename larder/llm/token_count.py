"""Token counts of a unigram tokenizer without making tokens.

An Aho-Corasick automaton lists the vocabulary entries that end at each character; dynamic programming
over characters carries the best score and the number of pieces on the way to it. Ties fall as in the
tokenizer: of equal scores the one stays that was reached first, and that is the piece that begins
earliest; an unknown character comes last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an unknown character costs beyond the lowest score of the vocabulary (a fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
#: Word counts that a task remembers at most.
_REMEMBERED = 400_000
_counters: dict[str, Callable] = {}


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) of a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def word_counter(pieces: list[tuple[str, float]]) -> Callable[[str], tuple[int, float]]:
    """word -> (pieces, score) of its best segmentation. An unknown character counts as one piece a byte
    if the vocabulary has all bytes (<0x00> to <0xFF>), else as one piece with its unknown neighbours."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, score in pieces:
        if piece:
            automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
    names = {piece for piece, _ in pieces}
    by_bytes = all(f"<0x{i:02X}>" in names for i in range(256))

    def count(word: str) -> tuple[int, float]:
        n = len(word)
        matches: list[list] = [[] for _ in range(n)]
        for end, match in automaton.iter(word):
            matches[end].append(match)  # the longest first
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        lost = [False] * (n + 1)  # the best way here ends with an unknown character
        for end in range(n):
            best, from_, single = None, 0, False
            for length, own in matches[end]:
                start = end + 1 - length
                if length == 1:
                    single = True
                if best is None or score[start] + own > best:
                    best, from_ = score[start] + own, start
            if not single and (best is None or score[end] + unknown > best):
                score[end + 1] = score[end] + unknown
                pieces[end + 1] = pieces[end] + (len(word[end].encode()) if by_bytes else not lost[end])
                lost[end + 1] = True
            else:
                score[end + 1], pieces[end + 1] = best, pieces[from_] + 1
        return pieces[n], score[n]

    return count


def words(text: str) -> list[str]:
    """Words as the tokenizer's Metaspace splits them: spaces become ▁ and begin a word; so does the text."""
    if not text:
        return []
    text = text.replace(" ", "▁")
    parts = text.split("▁")
    if not parts[0]:
        parts = parts[1:]
    return ["▁" + p for p in parts]


def token_counts(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_words, score), one row per row of `docs`.

    score is the sum of the best segmentations' scores. Null and empty texts have no tokens, no words
    and score 0. Repeated rows count each for itself. Other columns aren't read. The vocabulary must
    stand at the same path on every executor.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_file not in _counters:
            _counters[model_file] = word_counter(vocabulary(model_file))
        count = _counters[model_file]
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            out = []
            for t in batch.column(1):
                n, total = 0, 0.0
                ws = words(t.as_py() or "")
                for w in ws:
                    x = known.get(w)
                    if x is None:
                        x = count(w)
                        if len(w) <= 64:
                            if len(known) >= _REMEMBERED:
                                known.clear()
                            known[w] = x
                    n += x[0]
                    total += x[1]
                out.append((n, len(ws), total))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64())))],
                names=["doc_id", "n_tokens", "n_words", "score"],
            )

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(of, "doc_id long, n_tokens long, n_words long, score double")
