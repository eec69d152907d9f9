"""Token counts of whole texts under a piece vocabulary, most of them looked up instead of merged.

Offline, once in each task, three things are proved from the vocabulary file alone:

* white space only leads pieces: no piece holds a space mark after another character, so no merge crosses from a
  character to a following space mark, and a text may be cut there;
* loners: characters that are in no piece of two or more characters never merge with a neighbour, so a text may be cut
  on both sides of them (line ends and digits, as a rule);
* whole tokens: the pieces which, encoded alone, come out as one token.

A text is then cut into pre-tokens. Those that are whole tokens count one; only the rest are merged, by the library,
once for each different pre-token that a task remembers. The counts add up to those of the library for the whole text.

Rows: null texts count as empty, an empty text has no tokens, repeated rows give repeated results, an empty table gives
an empty table. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vocatio.llm.common import Remembered, arrow_map, texts_of

MARK = "▁"  # the vocabulary's sign for a space


class PieceCounter:
    """Counts tokens as the sentencepiece library does for the model at ``path``."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size()) if self._ordinary(i)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        if self.library.encode("a  b ", out_type=str) != self.library.encode("a", out_type=str) + [MARK, MARK + "b", MARK]:
            # Texts must stay as they are, with one space put before them.
            if "".join(self.library.encode("a  b ", out_type=str)) != f"{MARK}a{MARK}{MARK}b{MARK}":
                raise ValueError("this model changes white space: its texts can't be cut before it has done so")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        loners = "".join(c for c in map(chr, range(1, 128)) if c not in joined and c != " ")
        if "\n" not in loners:
            raise ValueError("line ends are part of longer pieces: texts can't be cut there")
        one = f"[{re.escape(loners)}]"
        self.cut = re.compile(f"{one}| *[^ {re.escape(loners)}]+| +").findall
        self.counts = Remembered(self.merged)
        # The proof of the whole tokens; they stay in memory apart from the others.
        shown = [p.replace(MARK, " ") for p in pieces]
        alone = self.library.encode(["\n" + p for p in shown], num_threads=1)
        self.whole = {p for p, ids in zip(shown, alone) if len(ids) == 3}

    def _ordinary(self, i: int) -> bool:
        lib = self.library
        return not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))

    def merged(self, token: str) -> int:
        """Tokens of one pre-token: 1 for a whole token, else by merging it behind a line end, which adds two tokens."""
        return 1 if token in self.whole else len(self.library.encode("\n" + token, num_threads=1)) - 2

    def count(self, text: str) -> int:
        if not text:
            return 0
        # The library puts one space before every text, and takes a space mark for a space.
        return sum(map(self.counts.__getitem__, self.cut(" " + text.replace(MARK, " "))))


def count_tokens(
    docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """For each row its id, ``n_bytes`` (UTF-8), ``n_tokens`` under the model at ``model``, and ``over_limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for batch in batches:
            texts = texts_of(batch, text_col)
            counts = [counter.count(t) for t in texts]
            columns = [
                batch.column(id_col),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(counts, pa.int64()),
                pa.array([n > limit for n in counts], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
