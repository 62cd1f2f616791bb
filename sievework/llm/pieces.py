"""SentencePiece merge-type encoding by backtracking, and decoding.

A text is encoded without running its merges. An Aho-Corasick pass finds the longest piece that starts at each
position; pieces are laid from left to right, and a piece may follow another only if the two are compatible: merging
their joint characters anew gives exactly these two pieces. Where no piece fits, the position is marked in a bitfield
as failed and the last piece gives way to its next shorter prefix. A sequence whose neighbours are all compatible is
the one that merging the whole text would give.

Null and empty texts have no ids. Repeated rows, very long texts and further columns need no care: each text is
encoded on its own and only the text leaves the JVM.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "▁"
CACHED_CHARS = 64
CACHED_WORDS = 300_000
CHECKED_WORDS = 60_000
SLICE_BYTES = 4 << 20
CHECKED_SLICE_BYTES = 1 << 20
CACHED_PAIRS = 1_000_000


class PieceModel:
    """Vocabulary of a merge-type model file, with what encoding and decoding need.

    The pieces are read through the sentencepiece library; encoding and decoding are done here."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        silent = {i for i in range(size) if model.is_control(i)}
        special = silent | set(self.byte_of) | {self.unknown}
        normal = [i for i in range(size) if i not in special and not model.is_unused(i)]
        self.rank = {self.pieces[i]: -model.get_score(i) for i in normal}
        self.id_of = {self.pieces[i]: i for i in normal}
        # A piece that merging its own characters doesn't give never comes up in any text.
        whole = [i for i in normal if self.merge(self.pieces[i]) == [self.pieces[i]]]
        self.length = [0] * size
        self.shorter = [-1] * size
        within = {self.pieces[i] for i in whole}
        finder = ahocorasick.Automaton()
        for i in whole:
            piece = self.pieces[i]
            self.length[i] = len(piece)
            self.shorter[i] = next((self.id_of[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in within), -1)
            finder.add_word(piece, i)
        finder.make_automaton()
        self.finder = finder
        self.known = {c for i in normal for c in self.pieces[i]} & within
        # No piece holds any other two neighbours, so a text may be cut between them and its parts encoded alone.
        self.inner = {p[i : i + 2] for p in self.id_of for i in range(len(p) - 1)}
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in self.id_of) and not any("\n" in p for p in self.id_of)
        self.pairs: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.n_pairs = 0
        self.most_words = CACHED_WORDS
        self.words = _Words(self, {})
        self.signs = {c: array("i", [self.id_of[c]]).tobytes() for c in self.known}
        self.surface = [p.replace(SPACE, " ") for p in self.pieces]
        for i in silent:
            self.surface[i] = ""
        self.surface[self.unknown] = " ⁇ "
        self.silent = silent
        raw = [bytes([self.byte_of[i]]) if i in self.byte_of else x.encode() for i, x in enumerate(self.surface)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(x) for x in raw])
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.leads = np.array([p.startswith(SPACE) for p in self.pieces], np.int64)
        self.is_silent = np.isin(np.arange(size), list(silent))
        for i, b in self.byte_of.items():
            if b < 128:
                self.surface[i] = chr(b)
        self.unusual = silent | {i for i, b in self.byte_of.items() if b >= 128}

    def forget(self) -> None:
        """Drop the words and pairs met so far."""
        self.words = _Words(self, {})
        self.pairs, self.n_pairs = [{} for _ in self.pieces], 0

    def merge(self, text: str) -> list[str]:
        """The merges themselves: the best-ranked adjacent pair first, the leftmost of equals."""
        parts, rank, none = list(text), self.rank, np.inf
        ranks = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1], none)
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces anew gives these two pieces; answers are kept."""
        answers = self.pairs[left]
        known = answers.get(right)
        if known is None:
            if self.n_pairs >= CACHED_PAIRS:
                self.pairs, self.n_pairs = [{} for _ in self.pieces], 0
                answers = self.pairs[left]
            a, b = self.pieces[left], self.pieces[right]
            known = answers[right] = self.merge(a + b) == [a, b]
            self.n_pairs += 1
        return known

    def _laid(self, text: str) -> list[int]:
        """Pieces of a text all of whose characters are in the vocabulary."""
        pairs, compatible, length = self.pairs, self.compatible, self.length
        laid: list[int] = []
        at, before = 0, -1
        for _, piece in self.finder.iter_long(text):  # longest matches end to end, as long as neighbours fit
            if before >= 0:
                fits = pairs[before].get(piece)
                if not (compatible(before, piece) if fits is None else fits):
                    break
            laid.append(piece)
            at += length[piece]
            before = piece
        else:
            return laid
        size, shorter = len(text), self.shorter
        longest = [-1] * size
        for last, piece in self.finder.iter(text, at):
            longest[last + 1 - length[piece]] = piece  # later matches from the same start are longer
        start = at
        failed = 0 if size <= CACHED_CHARS else bytearray(size // 8 + 1)
        piece = shorter[longest[at]]
        while at < size:
            before = laid[-1] if laid else -1
            while piece >= 0:
                end = at + length[piece]
                if not (failed >> end & 1 if size <= CACHED_CHARS else failed[end >> 3] >> (end & 7) & 1):
                    if before < 0:
                        break
                    fits = pairs[before].get(piece)
                    if compatible(before, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                laid.append(piece)
                at += length[piece]
                piece = longest[at] if at < size else -1
            else:
                if size <= CACHED_CHARS:
                    failed |= 1 << at
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                last = laid.pop()
                at -= length[last]
                piece = shorter[last]
                if at < start:  # before the part searched so far
                    start = at
                    for last, match in self.finder.iter(text, at):
                        longest[last + 1 - length[match]] = match
        return laid

    def _part(self, part: str) -> bytes:
        """Packed ids of a stretch in which blanks are escaped already."""
        inner, start, ids = self.inner, 0, []
        for i in range(1, len(part) + 1):
            if part[i - 1 : i + 1] not in inner:  # the end of the stretch is a cut, too
                ids.append(self._uncut(part[start:i]))
                start = i
        return ids[0] if len(ids) == 1 else b"".join(ids)

    def _uncut(self, part: str) -> bytes:
        if len(part) == 1 and part not in self.known:
            return array("i", [self.bytes[b] for b in part.encode()] if self.bytes else [self.unknown]).tobytes()
        if len(part) > 1 and part[0] == SPACE and part[1] != SPACE and self.by_word:
            known = self.words.get(part[1:])
            return known if known is not None else self.words.keep(part[1:], array("i", self._laid(part)).tobytes())
        return array("i", self._laid(part)).tobytes()

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as consecutive 32-bit integers."""
        if not text:
            return b""
        if not self.by_word:
            return self._part(SPACE + text.replace(" ", SPACE))
        text = text.replace(SPACE, " ")
        keys: list[str] = []
        ids: list[bytes] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if "" in words:  # runs of blanks are pieces of their own
                ids += map(self.words.__getitem__, keys)
                keys = []
                ids.append(self._part(("\n" if k else SPACE) + line.replace(" ", SPACE)))
                continue
            if k:
                words[0] = "\n" + words[0]
            keys += words
        ids += map(self.words.__getitem__, keys)
        return b"".join(ids)

    def encode(self, text: str | None) -> list[int]:
        return list(memoryview(self.packed(text)).cast("i"))

    def decode(self, ids: Iterable[int] | None) -> str:
        """Text of any id sequence: one leading blank goes, bytes that form no character become U+FFFD each."""
        ids = [] if ids is None else ids if isinstance(ids, list) else list(ids)
        first = next((k for k, i in enumerate(ids) if i not in self.silent), None)
        if first is None:
            return ""
        lead = 1 if self.pieces[ids[first]].startswith(SPACE) else 0
        surface = self.surface
        if self.unusual.isdisjoint(ids):
            return "".join(map(surface.__getitem__, ids))[lead:]
        out: list[str] = []
        run = bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                run.append(byte)
                continue
            if run:
                out.append(_characters(run))
                run = bytearray()
            out.append(surface[i])
        out.append(_characters(run))
        return "".join(out)[lead:]


class _Words(dict):
    """Ids of words met so far: ``word`` stands for the word after one blank, ``\\nword`` for the start of a line.

    Two halves of bounded size; words in use move on from the older one."""

    def __init__(self, model: PieceModel, older: dict):
        super().__init__()
        self.model, self.older = model, older

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        return self.keep(word, self._new(word) if ids is None else ids)

    def _new(self, word: str) -> bytes:
        model = self.model
        if word[:1] != "\n":
            part, known = SPACE + word, model.known
            if len(part) > 2 and part[-1] in known and part[-2:] not in model.inner:  # one sign after a word
                head = self.get(word[:-1])
                if head is None and known.issuperset(part):
                    head = self.keep(word[:-1], array("i", model._laid(part[:-1])).tobytes())
                if head is not None:
                    return head + model.signs[part[-1]]
            elif known.issuperset(part):  # the word is looked at as a whole
                return array("i", model._laid(part)).tobytes()
        return model._part(word if word[:1] == "\n" else SPACE + word)

    def keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= CACHED_CHARS:
            if len(self) >= self.model.most_words:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _characters(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        at += n
    return "".join(out)


@lru_cache(maxsize=4)
def model_at(path: str) -> PieceModel:
    """One model for each Python worker and file."""
    return PieceModel(path)


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of stretches laid end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 2**31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return at


def _list_array(ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int32()))


def _encoded(model: PieceModel, texts: pa.Array) -> pa.Array:
    """Ids of some thousand texts: words are looked up once for all of them, their ids are laid out by numpy."""
    texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
    if not model.by_word or pc.any(pc.match_substring_regex(texts, r"  |^ | $| \n|\n ")).as_py():
        packed = [model.packed(t) for t in texts.to_pylist()]
        return _list_array(np.cumsum([0] + [len(x) // 4 for x in packed]), np.frombuffer(b"".join(packed), np.int32))
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    words = split.flatten().dictionary_encode()
    packed = list(map(model.words.__getitem__, words.dictionary.to_pylist()))
    sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
    ids = np.frombuffer(b"".join(packed), np.int32)
    index = words.indices.to_numpy()
    starts = split.offsets.to_numpy() - split.offsets[0].as_py()
    lengths = sizes[index]
    lengths[starts[:-1][pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)]] = 0  # an empty text is split into one empty word
    laid = ids[_gather((np.cumsum(sizes) - sizes)[index], lengths)]
    ends = np.concatenate(([0], np.cumsum(lengths)))[starts]
    return _list_array(ends, laid)


def _decoded(model: PieceModel, lists: pa.Array) -> pa.Array:
    """Texts of some thousand id lists; all bytes are laid out at once, and looked at singly only where that isn't text."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type))
    ends = lists.offsets.to_numpy().astype(np.int64)
    ids = lists.values.to_numpy()[ends[0] : ends[-1]]
    ends = ends - ends[0]
    if not len(ids) or not model.is_silent[ids].any():
        starts, lengths = model.raw_starts[ids], model.raw_lengths[ids]
        firsts = ends[:-1][ends[:-1] < ends[1:]]
        lead = model.leads[ids[firsts]]
        starts[firsts] += lead
        lengths[firsts] -= lead
        raw = model.raw[_gather(starts, lengths)]
        offsets = np.concatenate(([0], np.cumsum(lengths)))[ends].astype(np.int32)
        text = pa.StringArray.from_buffers(len(lists), pa.py_buffer(offsets), pa.py_buffer(raw))
        try:
            text.validate(full=True)
            return text
        except pa.ArrowInvalid:
            pass
    return pa.array([model.decode(x) for x in lists.to_pylist()], pa.string())


def _slices(rows: pa.Array, sizes: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Batches come by number of rows; they are worked through in slices of about ``slice_bytes``."""
    slice_of = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // slice_bytes
    cuts = [0, *(np.flatnonzero(np.diff(slice_of)) + 1).tolist(), len(rows)]
    return (rows[a:b] for a, b in zip(cuts, cuts[1:]) if a < b)


def _by_slices(run, model: PieceModel, rows: pa.Array, sizes: pa.Array, kind: pa.DataType) -> pa.Array:
    if not len(rows):
        return pa.array([], kind)
    done = pa.concat_arrays([run(model, part) for part in _slices(rows, sizes)])
    pa.default_memory_pool().release_unused()  # workers live on and share an executor's memory with later stages
    return done


def encode(text: Column, model_file: str) -> Column:
    """Ids of a text column, ``array<int>``, as the model's own library gives them without begin and end marks."""

    @F.arrow_udf("array<int>")
    def piece_ids(texts: pa.Array) -> pa.Array:
        model = model_at(model_file)
        return _by_slices(_encoded, model, texts, pc.binary_length(texts), pa.list_(pa.int32()))

    return piece_ids(text)


def decode(ids: Column, model_file: str) -> Column:
    """Text of an ``array<int>`` column of ids; null and empty give the empty text."""

    @F.arrow_udf("string")
    def piece_text(lists: pa.Array) -> pa.Array:
        model = model_at(model_file)
        return _by_slices(_decoded, model, lists, pc.multiply(pc.list_value_length(lists), 4), pa.string())

    return piece_text(ids)


def encode_checked(text: Column, model_file: str) -> Column:
    """struct(ids, round_trip): ids as ``encode`` gives them, and whether they decode to the text, in which null counts as empty
    and U+2581 as a blank. One Python worker a task does both, and no decoded text leaves it. Workers share an executor's memory
    with other stages, so each slice leaves at once, a worker keeps ``CHECKED_WORDS`` words at most twice over, and at a task's end
    it forgets them."""

    @F.arrow_udf("struct<ids:array<int>,round_trip:boolean>")
    def ids_and_check(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _checked(model_at(model_file), batches)

    return ids_and_check(text)


def _checked(model: PieceModel, batches: Iterable[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])
    model.most_words = CHECKED_WORDS
    try:
        for texts in batches:
            for part in _slices(texts, pc.binary_length(texts), CHECKED_SLICE_BYTES):
                ids = _encoded(model, part)
                plain = pc.replace_substring(pc.fill_null(part, ""), SPACE, " ")
                yield pa.StructArray.from_arrays([ids, pc.equal(_decoded(model, ids), plain)], fields=list(kind))
            pa.default_memory_pool().release_unused()
    finally:
        model.most_words = CACHED_WORDS
        model.forget()
