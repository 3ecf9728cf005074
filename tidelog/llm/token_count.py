"""Token counts by overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks with offsets. Two chunks are
spliced at a boundary that both encodings have inside their overlap and that is *proven* stable:
no vocabulary piece holds the two characters around it side by side, so no merge of the whole
text could ever cross it. Where the overlap has no such boundary it is doubled, up to the whole
text, which keeps the count equal to that of one single call whatever the text is.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import map_rows

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
TOKEN_LIMIT = 4_096


class ChunkedPieceCounter:
    """Counts the pieces of a sentencepiece BPE model; equal to ``len(encode(text))`` for every text."""

    def __init__(self, model_file: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> None:
        import sentencepiece

        self.whole = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk_chars, overlap_chars
        n = self.whole.vocab_size()
        pieces = [self.whole.id_to_piece(i) for i in range(n) if not (self.whole.is_byte(i) or self.whole.is_control(i) or self.whole.is_unknown(i))]
        #: Characters that some piece holds side by side; a merge can only join such pairs.
        self.joined = {a + b for p in pieces for a, b in zip(p, p[1:], strict=False)}
        #: Chunks need a model that leaves characters as they are (offsets hold) and knows a line feed only as a byte.
        probe = "  a  b\tﬁ Å\n ü "
        self.identity = self.whole.normalize(probe) == "▁" + probe.replace(" ", "▁") and self.whole.encode("\n", out_type=str) == ["▁", "<0x0A>"]
        self.bytes = [self.whole.is_byte(i) for i in range(n)]
        self.widened = 0

    def _ends(self, text: str) -> list[int]:
        """Character offset of each token's end; the bytes of one character all have that character's end.

        The model puts a space before a text. A line feed keeps that space from the chunk; their two tokens are left out.
        """
        ends, at, pending = [], 0, 0
        ids = self.whole.encode("\n" + text)[2:]
        for piece, i in zip(self.whole.id_to_piece(ids), ids, strict=True):
            if piece == "<unk>" or self.bytes[i]:
                pending = pending - 1 if pending else len(text[at].encode()) - 1
                at += not pending
            else:
                at += len(piece)
            ends.append(at + (pending > 0))
        return ends

    def _stable(self, text: str, at: int) -> bool:
        a, b = text[at - 1].replace(" ", "▁"), text[at].replace(" ", "▁")
        return a + b not in self.joined

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk or not self.identity]
        for i, ids in zip(short, self.whole.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk and self.identity:
                out[i] = self._spliced(t)
        return out

    def _spliced(self, text: str) -> int:
        # The model's own leading space, so that every chunk is encoded without one.
        text = " " + text
        total, start, n = 0, 0, len(text)
        while True:
            end, overlap = min(n, start + self.chunk), self.overlap
            ends = self._ends(text[start:end])
            if end == n:
                return total + len(ends)
            while True:
                # The next chunk begins inside this one; a boundary both have in the overlap joins them.
                begin = max(start + 1, end - overlap)
                after = self._ends(text[begin : min(n, end + overlap)])
                mine = {start + e for e in ends if begin < start + e < end}
                common = [p for e in after if (p := begin + e) in mine and self._stable(text, p)]
                if common:
                    cut = common[len(common) // 2]
                    total += sum(start + e <= cut for e in ends)
                    start = cut
                    break
                self.widened += 1
                if end == n:
                    return total + len(ends)
                overlap *= 2
                end = min(n, end + overlap)
                ends = self._ends(text[start:end])


def count_tokens(
    docs: DataFrame, model_file: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, limit: int = TOKEN_LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs`` (columns doc_id, text; others are ignored).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results and a null
    doc_id stays null. An empty table gives an empty result. No shuffle: a narrow map over the scan.
    """

    def make():
        counter = ChunkedPieceCounter(model_file, chunk_chars, overlap_chars)

        def step(batch: pa.RecordBatch) -> dict[str, list]:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts: list[int] = []
            for at in range(0, len(texts), 256):
                counts += counter.counts(texts[at : at + 256])
            return {"doc_id": batch.column("doc_id").to_pylist(), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts, "over_limit": [c > limit for c in counts]}

        return step

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean", make)
