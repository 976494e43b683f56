"""Token counts of a unigram tokenizer without making tokens: Viterbi that carries score and count only.

An Aho-Corasick automaton lists every vocabulary piece that ends at a position of a word. The best score of
the position is the best over these pieces; the count comes along. Ties are decided as the tokenizers library
does: starts are tried from left to right and only a strictly better score replaces, so of equal scores the
longest last piece stays. A character that is no piece costs the lowest score less 10 and counts as its UTF-8
bytes (byte fallback). Words begin at spaces, as its Metaspace pre-tokenizer cuts them.

Cases: a null or empty text has 0 tokens; repeated rows are counted row by row; rows, nulls in other columns and
extra columns are kept (a column that has the result's name is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

#: Words remembered by a task; when full, the memory starts anew.
MEMO = 300_000


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a SentencePiece file; its size is fixed by the file."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class WordCounter(dict):
    """Token counts of words, each worked out when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.unknown = min(score for _, score in vocabulary) - 10.0

    def __missing__(self, word: str) -> int:
        text = "▁" + word
        size = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for last, piece in self.automaton.iter(text):
            ending[last].append(piece)
        score, count = [0.0] * (size + 1), [0] * (size + 1)
        for last in range(size):
            best = None
            tokens = 0
            for length, gain in ending[last]:
                start = last + 1 - length
                if best is None or score[start] + gain > best:
                    best, tokens = score[start] + gain, count[start] + 1
            if text[last] not in self.single and (best is None or score[last] + self.unknown > best):
                best, tokens = score[last] + self.unknown, count[last] + len(text[last].encode())
            score[last + 1], count[last + 1] = best, tokens
        if len(self) >= MEMO:
            self.clear()
        self[word] = count[size]
        return count[size]

    def of_text(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace("▁", " ").split(" ")
        if text[0] in " ▁":
            del parts[0]
        return sum(map(self.__getitem__, parts))


def token_counts(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of every whole text as the long column ``out``."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(unigram_vocabulary(model_path))
    kept = docs.drop(out) if out != text else docs
    names = kept.columns

    def count(batches):
        counter = WordCounter(vocabulary.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                n = [counter.of_text(x) if x else 0 for x in pc.cast(part.column(text), pa.string()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64())], names=[*names, out])

    return kept.mapInArrow(count, kept.selectExpr("*", f"0L AS `{out}`").schema)
