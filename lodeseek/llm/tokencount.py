"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The distinct pre-tokens of a batch of texts are the terminals of a trie, which is walked depth first (their sorted order).
A trie node carries the forward score of its prefix: the best segmentation's score and pieces, and the places in the piece
trie where a piece that began earlier may still go on. These are computed once per node, however many pre-tokens share the
prefix, from the parent's alone; only pieces that do go on are followed. Counts are kept at the terminals: those of a batch's
pre-tokens, and of up to `max_words` of earlier ones, so a frequent pre-token is scored once a task. Only the path to
the current node is held, so a batch needs memory for its own pre-tokens. Texts are counted where they are read: nothing is shuffled.

The scores are made from the vocabulary's rank order (see `unigram`), as a merge vocabulary states none. Counts are exact
for these scores, and equal those of no published tokenizer.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lodeseek.llm.common import fields, slices, slim, utf8

VOCABULARY = "piece_bpe_32k.model"
_MARK = "▁"


def unigram(path: str) -> tuple[dict[str, float], float]:
    """Scores of the pieces in a sentencepiece file, and the score of a character without one.

    The file lists its pieces in falling frequency, so a piece's log-probability is taken from Zipf's law over its rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    scores = {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}
    return scores, min(scores.values()) - 10.0


class Counter:
    """Pieces of the best segmentation of pre-tokens; ties go to the longer last piece.

    A character without a piece costs one piece for each of its UTF-8 bytes.
    """

    def __init__(self, scores: dict[str, float], missing: float, max_words: int = 400_000):
        self.missing, self.max_words, self.known = missing, max_words, {}
        self.pieces: dict = {}  # piece trie: character -> node; "" -> score
        for piece, score in scores.items():
            node = self.pieces
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = score

    def node(self, char: str, best: float, count: int, open_: list) -> tuple[float, int, list]:
        """The trie node under char: score, pieces and open places, from those of its parent."""
        top, pieces, follow = -math.inf, 0, []
        for at, before, n in open_:
            at = at.get(char)
            if at is not None:
                if len(at) > 1 or "" not in at:
                    follow.append((at, before, n))
                own = at.get("")
                if own is not None and before + own > top:
                    top, pieces = before + own, n + 1
        at = self.pieces.get(char)  # pieces that begin here
        if at is not None and "" in at:
            own, n = at[""], 1
        else:
            own, n = self.missing, len(char.encode())
        if best + own > top:
            top, pieces = best + own, count + n
        if at is not None:
            follow.append((at, best, count))
        return top, pieces, follow

    def counts(self, words: Iterable[bytes], long_word: int) -> dict[bytes, int]:
        """Pre-token -> pieces, for a batch's pre-tokens."""
        known = self.known
        out = {w: known[w] for w in words if w in known}
        path, before = [self.node(_MARK, 0.0, 0, [])], ""
        node = self.node
        for word, raw in sorted((w.decode(), w) for w in words if w not in known):
            if len(word) > long_word:  # not held as a path
                now = path[0]
                for char in word:
                    now = node(char, *now)
                out[raw] = now[1]
                continue
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del path[depth + 1 :]
            now = path[depth]
            for char in word[depth:]:
                now = node(char, *now)
                path.append(now)
            out[raw], before = now[1], word
        # The counts of earlier batches stay while there is room; else those of this batch, frequent pre-tokens among them.
        self.known = known | out if len(known) + len(out) <= self.max_words else out
        return out


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, max_words: int = 400_000, long_word: int = 256) -> DataFrame:
    """A row for each row of docs: id_col, n_pretokens, n_tokens (long). Pre-tokens are runs without ASCII white space.

    A null or empty text has none. Null and repeated ids come back as they are; an empty table gives no rows; other columns are
    not read. Pre-tokens over long_word characters are scored by the same recurrence, but not as a path of the trie. path:
    the vocabulary file, on every machine.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    rows = slim(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, missing = unigram(path)
        counter = Counter(scores, missing, max_words)
        for batch in slices(batches, "text"):
            texts = [(t or b"").split() for t in utf8(batch.column("text"))]
            found = counter.counts(set().union(*texts), long_word)
            counts = [sum(map(found.__getitem__, words)) for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(counts, pa.int64())], names=["id", "n_pretokens", "n_tokens"])

    return rows.mapInArrow(run, fields(rows.schema["id"], "n_pretokens long, n_tokens long")).withColumnRenamed("id", id_col)
