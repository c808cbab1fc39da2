"""Encoding and decoding by a merge-type piece model (a .model file of BPE kind with byte fallback).

A text's encoding is read off a prefix table: for each prefix, the one last token of that prefix's own
encoding. A token that ends where the prefix ends (an automaton over all pieces finds them) is that last
token if and only if it is compatible with the last token of what lies before it, that is, if the two,
merged by themselves, stay the two; for an encoding is right when all its neighbours are compatible. Ids
are then recovered from the end of the table backwards. The work is linear in the text, however long.

Texts are cut between characters that no piece of the vocabulary holds side by side (checked when the model
is loaded): before runs of spaces, and where Latin letters meet others. The ids of frequent cuts are
remembered.

Nulls and empty texts give no ids and an empty text; very long texts are encoded whole; of equal scores the
leftmost pair merges first, as in the library; U+2581 counts as a space, as in the library; repeated rows
stay and get equal ids; an empty table gives an empty one; a column whose name clashes with a new one is
replaced.
"""

from __future__ import annotations

import codecs
import re
from array import array
from itertools import groupby
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larder.llm.common import as_texts, map_batches

#: Cuts, and pairs of tokens, that a worker remembers.
CACHE_CUTS, CACHE_PAIRS = 1 << 18, 1 << 19
#: Texts whose ids a worker holds at a time.
ROWS = 128
SPACE = "▁"
#: In the prefix table: the empty prefix, and a character that no piece has.
START, UNKNOWN = -1, -2
#: Cuts that differ only in where two characters meet, the finest first.
LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
CUTS = [re.compile(p).findall for p in (f" *[{LATIN}]+| *[^ {LATIN}]+| +", " *[^ ]+| +")]

codecs.register_error("larder-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceCodec:
    """Encodes and decodes as the model's library does, without begin or end ids."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        number = range(model.get_piece_size())
        special = {i for i in number if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.byte_ids = np.full(256, -1, np.int32)
        self.texts, self.score, self.id_of = [], {}, {}
        self.odd = np.zeros(len(number), bool)  # ids that decode otherwise than by their text alone
        self.plain_byte = np.zeros(len(number), bool)
        self.unknown_text = model.decode([model.unk_id()])
        self.unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for i in number:
            piece = model.id_to_piece(i).replace(SPACE, " ")
            byte = int(piece[3:5], 16) if model.is_byte(i) else -1
            if byte >= 0:
                self.byte_ids[byte] = i
            self.plain_byte[i] = 0 <= byte < 128
            self.odd[i] = byte >= 128 or i in special
            self.texts.append("" if self.odd[i] else chr(byte) if byte >= 0 else piece)
            if byte < 0 and not self.odd[i]:
                self.score[piece], self.id_of[piece] = model.get_score(i), i
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids)}
        self.check(model)
        self.sizes = [len(t) for t in self.texts]
        self.cuts: dict[str, bytes] = {}
        #: By the token before, START and UNKNOWN last: nothing merges with a character that no piece has.
        self.pairs: list[dict[int, bool]] = [{} for _ in number]
        self.pairs += [{}] * 2
        self.tested = 0
        self.histories: dict[int, tuple[list[float], list[str], list[str]] | None] = {}

    def check(self, model) -> None:
        """Raise where the model does what this codec doesn't: the cuts and the table rest on it."""
        pieces = self.id_of
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no piece for some byte")
        if any(c not in pieces for p in pieces for c in p):
            raise ValueError("a piece has a character that isn't a piece itself")
        self.cut = next((cut for cut in CUTS if all(cut(p) == [p] for p in pieces)), None)
        if self.cut is None:
            raise ValueError("a piece has a space after another character, so texts can't be cut before spaces")
        for probe in ("a", " a  b ", "\tAﬁ Å é"):
            if model.decode(model.encode(probe)) != probe:
                raise ValueError("the model changes texts before it encodes them")

    def steps(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece merges by itself: each step's score, and its first and last part before each step and at the end; None if it doesn't become one.

        The pair of the best score merges first, of equal ones the leftmost.
        """
        if token not in self.histories:
            symbols, score = list(self.texts[token]), self.score
            scores, firsts, lasts = [], [symbols[0]], [symbols[-1]]
            while True:
                best, at = -inf, -1
                for k in range(len(symbols) - 1):
                    if score.get(symbols[k] + symbols[k + 1], -inf) > best:
                        best, at = score[symbols[k] + symbols[k + 1]], k
                if at < 0:
                    break
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                scores.append(best)
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
            self.histories[token] = ([*scores, -inf], firsts, lasts) if len(symbols) == 1 else None
        return self.histories[token]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two tokens, merged by themselves, stay the two; at the start, whether the token becomes one.

        Either goes its own steps, the better-scored one's first, unless its neighbouring parts merge before.
        """
        row = self.pairs[before]
        if (known := row.get(token)) is None:
            if self.tested > CACHE_PAIRS:
                for one in self.pairs:
                    one.clear()
                self.tested = 0
            self.tested += 1
            known = row[token] = self._compatible(before, token)
        return known

    def _compatible(self, before: int, token: int) -> bool:
        right = self.steps(token)
        if right is None or before < 0:
            return right is not None
        left = self.steps(before)
        if left is None:
            return False
        (left_scores, _, lasts), (right_scores, firsts, _), i, j = left, right, 0, 0
        while True:
            across, one, other = self.score.get(lasts[i] + firsts[j], -inf), left_scores[i], right_scores[j]
            if across > one and across >= other and across > -inf:
                return False
            if one == other == -inf:
                return True
            if one >= other:
                i += 1
            else:
                j += 1

    def last_tokens(self, text: str) -> list[int]:
        """The prefix table: the last token of the encoding of each prefix of the text, the empty one first."""
        table = [UNKNOWN] * (len(text) + 1)
        table[0] = START
        pairs, compatible = self.pairs, self.compatible
        for last, (token, size) in self.automaton.iter(text):
            if table[last + 1] == UNKNOWN:
                before = table[last + 1 - size]
                fits = pairs[before].get(token)
                if compatible(before, token) if fits is None else fits:
                    table[last + 1] = token
        return table

    def encode_cut(self, text: str) -> list[int]:
        """Ids of a cut, by its prefix table."""
        table, ids, at = self.last_tokens(text), [], len(text)
        while at:
            if (token := table[at]) >= 0:
                ids.append(token)
                at -= self.sizes[token]
            else:
                ids += [int(self.byte_ids[b]) for b in reversed(text[at - 1].encode())]
                at -= 1
        return ids[::-1]

    def encode_spaced(self, text: str) -> bytes:
        """Ids, as 32-bit numbers, of a text in which spaces stand for U+2581, without any put before it."""
        cuts, known = self.cut(text), self.cuts
        missing = set(cuts).difference(known)
        if missing:
            if len(known) > CACHE_CUTS:
                known.clear()
                missing = set(cuts)
            known.update((c, array("i", self.encode_cut(c)).tobytes()) for c in missing)
        return b"".join(map(known.__getitem__, cuts))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit numbers."""
        return self.encode_spaced(" " + text.replace(SPACE, " ")) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that make no character become U+FFFD each, and the space before the first word goes."""
        odd = self.odd[ids]
        if not odd.any():
            text = "".join(map(self.texts.__getitem__, ids.tolist()))
            return text if len(ids) and self.plain_byte[ids[0]] else text.removeprefix(" ")
        odd, parts, at_start = self.odd | self.plain_byte, [], True
        for special, run in groupby(ids.tolist(), odd.__getitem__):
            if special:
                for is_byte, some in groupby(run, self.byte_of.__contains__):
                    if is_byte:
                        parts.append(bytes(map(self.byte_of.__getitem__, some)).decode("utf-8", "larder-each-byte"))
                    else:
                        parts += [self.unknown_text for i in some if i == self.unknown]
            else:
                text = "".join(map(self.texts.__getitem__, run))
                parts.append(text if any(parts) else text.removeprefix(" ") if at_start else text)
                at_start = False
        return "".join(parts)


_codecs: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec a worker process."""
    if model_file not in _codecs:
        _codecs[model_file] = PieceCodec(model_file)
    return _codecs[model_file]


def lists(ids: list[bytes]) -> pa.Array:
    """A column of lists of the 32-bit numbers."""
    ends = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def decoded(own: PieceCodec, ids: pa.Array) -> pa.Array:
    nothing = np.zeros(0, np.int32)
    return pa.array([own.decode(one.values.to_numpy(zero_copy_only=False) if one.is_valid else nothing) for one in ids], pa.string())


def encode(df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ids."""

    def make():
        own = codec(model_file)
        return lambda batch: [lists([own.encode(t) for t in as_texts(batch.column(text))])]

    return map_batches(df, make, "ids array<int>", keep, ROWS)


def decode(df: DataFrame, model_file: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Append decoded_text."""

    def make():
        own = codec(model_file)
        return lambda batch: [decoded(own, batch.column(ids))]

    return map_batches(df, make, "decoded_text string", keep, ROWS)


def encode_and_decode(df: DataFrame, model_file: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """What encode() and then decode() append, in one pass: a task holds one Python worker with one codec, not two."""

    def make():
        own = codec(model_file)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            ids = lists([own.encode(t) for t in as_texts(batch.column(text))])
            return [ids, decoded(own, ids)]

        return work

    return map_batches(df, make, "ids array<int>, decoded_text string", keep, ROWS)
