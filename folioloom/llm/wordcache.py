"""Exact tokenizer ids at several times the library's speed.

A tokenizer's pre-tokenizer never joins characters across certain places. Arrow
cuts a batch of texts there and looks all pieces up in a bounded cache at once;
numpy lays out their ids. Only unknown pieces are encoded: of those that are a
run of letters with marks after it, the distinct runs go to the library many at
once, as one text whose ids are divided where the vocabulary tells that a word
starts or ends; whatever else is unknown goes to it piece by piece.

A special token's marker in a text is that token's id, as the library has it by
default; texts are divided around markers beforehand.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces in the cache, at most, but for those that a batch adds; and runs of letters.
CACHE = 500_000
#: Runs of letters encoded as one text.
BULK = 20_000
#: Characters laid out at once, and the longest piece that is remembered.
CHARACTERS, LONGEST = 8_000_000, 100
#: White space as the byte-level pre-tokenizers know it.
SPACES = "\t\n\v\f\r \x85\xa0  -     　"
#: A piece for byte-level BPE: white space belongs to what follows it.
BYTE_PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
#: What keeps a text from being words with one blank or newline between them and no other white space or NUL.
UNEVEN = "[\\x00\\t\\x0b-\\r\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|\\A[ \\n]|[ \\n]\\z"
#: ASCII marks besides the apostrophe, which takes part in contractions.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that every version of Unicode has as letters, one for one in either case.
LETTERS = "A-Za-z\\x{c0}-\\x{d6}\\x{d8}-\\x{f6}\\x{f8}-\\x{12f}\\x{131}-\\x{21f}\\x{391}-\\x{3a1}\\x{3a3}-\\x{3c9}\\x{401}\\x{410}-\\x{44f}\\x{451}\\x{621}-\\x{63a}\\x{641}-\\x{64a}\\x{3041}-\\x{3094}\\x{30a1}-\\x{30fa}\\x{4e00}-\\x{9fa5}\\x{ac00}-\\x{d7a3}"


def spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all items of the ranges, range after range, and the ranges' ends among them, from 0."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    kind = np.int32 if ends[-1] < 1 << 31 and (not len(starts) or starts.max() < 1 << 31) else np.int64
    return np.repeat((starts - ends[:-1]).astype(kind), sizes) + np.arange(ends[-1], dtype=kind), ends


class Ids:
    """Runs of ids, one after another in ``flat``."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.starts = np.cumsum(sizes) - sizes

    def take(self, at: np.ndarray) -> Ids:
        sizes = self.sizes[at]
        return Ids(self.flat[spread(self.starts[at], sizes)[0]], sizes)

    def join(self, other: Ids) -> Ids:
        return Ids(np.concatenate((self.flat, other.flat)), np.concatenate((self.sizes, other.sizes)))


class Encoder:
    """kind "word": white space is dropped and case folded, so any blank or newline is a place to cut.
    kind "byte": a run of white space goes with the word after it. A piece stands for itself with one
    blank before it, after NUL for itself as it is, and after a newline for both.
    """

    held: dict[tuple[str, str], Encoder] = {}

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.type = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.markers = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.limit = kind, CACHE
        self.keys, self.ids, self.used = pa.array([], pa.string()), self._none(), np.zeros(0, bool)
        self.runs, self.run_ids = {}, self._none()
        #: Whether an id ends a word (kind "word") or starts one after a blank (kind "byte").
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.edge[i] = token.endswith("</w>") if kind == "word" else token.startswith("Ġ")
        self.newline = vocabulary.get("Ċ", -1)

    @classmethod
    def of(cls, path: str, kind: str, cache: int = CACHE) -> Encoder:
        """One per worker process."""
        if (path, kind) not in cls.held:
            cls.held[path, kind] = cls(path, kind)
        cls.held[path, kind].limit = cache
        return cls.held[path, kind]

    def _none(self, n: int = 0) -> Ids:
        return Ids(np.zeros(0, self.type), np.zeros(n, np.int64))

    def _singly(self, texts: list[str]) -> Ids:
        if not texts:
            return self._none()
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return Ids(np.fromiter((i for x in found for i in x), self.type, int(sizes.sum())), sizes)

    def _bulk(self, runs: list[str], head: str) -> Ids:
        """Of runs of letters, each after head (kind "byte": a blank, or nothing)."""
        out = self._none()
        for a in range(0, len(runs), BULK):
            part = runs[a : a + BULK]
            lines = self.kind == "byte" and not head
            text = "\n".join(part) if lines else head + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
            if lines:
                at = np.append(np.flatnonzero(ids == self.newline), len(ids))
                sizes = np.diff(np.concatenate(([-1], at))) - 1
                ids = ids[ids != self.newline]
            elif self.kind == "word":
                at = np.flatnonzero(self.edge[ids]) + 1
                sizes = np.diff(np.concatenate(([0], at)))
            else:
                at = np.flatnonzero(self.edge[ids])
                sizes = np.diff(np.append(at, len(ids)))
            whole = len(sizes) == len(part) and int(sizes.sum()) == len(ids)
            out = out.join(Ids(ids, sizes) if whole else self._singly([head + r for r in part]))
        return out

    def _known(self, runs: list[str], head: str) -> Ids:
        """Of distinct runs of letters, from the cache of runs as far as it has them."""
        names = runs if head or self.kind == "word" else ["\0" + r for r in runs]
        at = np.fromiter((self.runs.get(k, -1) for k in names), np.int64, len(names))
        new = np.flatnonzero(at < 0).tolist()
        n = len(self.run_ids.sizes)
        every = self.run_ids.join(self._bulk([runs[i] for i in new], head))
        at[new] = n + np.arange(len(new))
        if n + len(new) > self.limit:
            self.runs, self.run_ids = {}, self._none()
        else:
            self.runs.update((names[i], n + k) for k, i in enumerate(new))
            self.run_ids = every
        return every.take(at)

    def _bodies(self, bodies, head: str) -> Ids:
        """Of an Arrow array of pieces without white space around them, each after head."""
        import pyarrow.compute as pc

        if not len(bodies):
            return self._none()
        stems = pc.utf8_rtrim(bodies, characters=MARKS)
        plain = pc.match_substring_regex(stems, f"\\A[{LETTERS}]+\\z")
        plainly = plain.to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plainly)
        stems = stems.filter(plain)
        runs = (pc.ascii_lower(stems) if self.kind == "word" else stems).dictionary_encode()
        known = self._known(runs.dictionary.to_pylist(), head)
        tails = pc.replace_substring_regex(bodies.filter(plain), f"\\A[{LETTERS}]+", "").dictionary_encode()
        others = bodies.filter(pc.invert(plain)).to_pylist()
        parts = known.join(self._singly(tails.dictionary.to_pylist())).join(self._singly([head + o for o in others])).join(self._none(1))
        n, m = len(runs.dictionary), len(tails.dictionary)
        which = np.full((len(bodies), 2), len(parts.sizes) - 1)
        which[at, 0], which[at, 1] = runs.indices.to_numpy(), n + tails.indices.to_numpy()
        which[~plainly, 0] = n + m + np.arange(len(others))
        found = parts.take(which.ravel())
        return Ids(found.flat, found.sizes.reshape(-1, 2).sum(1))

    def _learn(self, new) -> Ids:
        import pyarrow.compute as pc

        if self.kind == "word":
            return self._bodies(new, "")
        line, still = pc.starts_with(new, "\n"), pc.starts_with(new, "\0")
        headed = pc.or_(line, still)
        parts = self._bodies(new.filter(pc.invert(headed)), " ")
        n = len(parts.sizes)
        parts = parts.join(self._bodies(pc.utf8_slice_codeunits(new.filter(headed), 1), "")).join(self._singly(["\n", ""]))
        headed, line = headed.to_numpy(zero_copy_only=False), line.to_numpy(zero_copy_only=False)
        which = np.full((len(new), 2), len(parts.sizes) - 1)
        which[line, 0] = len(parts.sizes) - 2
        which[~headed, 1], which[headed, 1] = np.arange(n), n + np.arange(len(new) - n)
        found = parts.take(which.ravel())
        return Ids(found.flat, found.sizes.reshape(-1, 2).sum(1))

    def _found(self, pieces) -> tuple[Ids, np.ndarray]:
        """Runs of ids, and the run of each piece of an Arrow array."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = pc.index_in(pieces, value_set=self.keys)
        missing = at.null_count
        places = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.used[places[places >= 0] if missing else places] = True
        if not missing:
            return self.ids, places
        new = pieces.filter(pc.is_null(at)).dictionary_encode()
        learnt = self._learn(new.dictionary)
        every = self.ids.join(learnt)
        places[places < 0] = len(self.keys) + new.indices.to_numpy().astype(np.int64)
        short = pc.less_equal(pc.binary_length(new.dictionary), LONGEST)
        if pc.all(short).as_py():
            keys, kept = new.dictionary, learnt
        else:
            keys, kept = new.dictionary.filter(short), learnt.take(np.flatnonzero(short.to_numpy(zero_copy_only=False)))
        if len(self.keys) + len(keys) > self.limit:  # those not used since the last time go
            stay = np.flatnonzero(self.used) if self.used.sum() + len(keys) <= self.limit else np.zeros(0, np.int64)
            self.keys, self.ids = self.keys.take(pa.array(stay)), self.ids.take(stay)
            self.used = np.zeros(len(stay), bool)
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ids = every if len(keys) == len(new.dictionary) and len(self.keys) == len(every.sizes) else self.ids.join(kept)
        self.used = np.concatenate((self.used, np.zeros(len(keys), bool)))
        return every, places

    def _even(self, rows):
        import pyarrow.compute as pc

        if self.kind == "word":
            return pc.split_pattern(pc.replace_substring(rows, "\n", " "), " ")
        return pc.split_pattern(pc.binary_join_element_wise("\0", pc.replace_substring(rows, "\n", " \n"), ""), " ")

    def _uneven(self, text: str) -> list[str]:
        return [p[1:] if p[0] == " " and BYTE_PIECE.match(p[1:2]) and p[1:2].strip("\0 ") and not p[1].isspace() else "\0" + p for p in BYTE_PIECE.findall(text)]

    def _lay(self, rows) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of an Arrow array, and the rows' ends among them, from 0."""
        import pyarrow as pa
        import pyarrow.compute as pc

        places = None
        if self.kind == "byte" and len(uneven := np.flatnonzero(pc.match_substring_regex(rows, UNEVEN).to_numpy(zero_copy_only=False))):
            odd = np.zeros(len(rows), bool)
            odd[uneven] = True
            even = self._even(rows.filter(pa.array(~odd)))
            lists = pa.concat_arrays([even, pa.array([self._uneven(t) for t in rows.filter(pa.array(odd)).to_pylist()], even.type)])
            places = np.empty(len(rows), np.int64)
            places[np.concatenate((np.flatnonzero(~odd), uneven))] = np.arange(len(rows))
        else:
            lists = self._even(rows)
        ids, at = self._found(lists.flatten())
        offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
        if places is not None:
            order, offsets = spread(offsets[:-1][places], np.diff(offsets)[places])
            at = at[order]
        sizes = ids.sizes[at]
        index, ends = spread(ids.starts[at], sizes)
        return ids.flat[index], ends[offsets]

    def _divided(self, text: str, most: int) -> list[str]:
        """Parts of a text whose ids, one after another, are the text's: around markers, and of long texts at blanks between words."""
        parts = re.split("(" + "|".join(map(re.escape, self.markers)) + ")", text) if self.markers else [text]
        out = []
        for part in parts:
            start = 0
            while len(part) - start > most:
                cut = re.compile(f"[^{SPACES}\0] (?=[^{SPACES}\0])").search(part, start + most // 2)
                if not cut:
                    break
                out.append(part[start : cut.start() + 1])
                start = cut.start() + 1
            out.append(part[start:])
        return out

    def encode(self, texts, characters: int = CHARACTERS) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a list or an Arrow array, nulls empty), and the texts' ends among them, from 0."""
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        special = pc.greater(pc.binary_length(rows), characters)
        for m in self.markers:
            special = pc.or_(special, pc.match_substring(rows, m))
        counts = None
        if pc.any(special).as_py():
            parts = [self._divided(t, characters) if s else [t] for t, s in zip(rows.to_pylist(), special.to_pylist())]
            counts = np.array([len(p) for p in parts], np.int64)
            rows = pa.array([x for p in parts for x in p], pa.string())
        lengths = pc.binary_length(rows).to_pylist()
        found, ends = [np.zeros(0, self.type)], [np.zeros(1, np.int64)]
        for a, b in slices(len(rows), lengths, characters):
            ids, own = self._lay(pa.concat_arrays([rows.slice(a, b - a)]))
            found.append(ids)
            ends.append(own[1:] + ends[-1][-1])
        ids, ends = np.concatenate(found), np.concatenate(ends)
        return ids, ends if counts is None else ends[np.concatenate(([0], np.cumsum(counts)))]


def slices(n: int, lengths, most: int = CHARACTERS):
    """Ranges of rows with at most so many characters each, or one row."""
    start, total = 0, 0
    for i in range(n):
        total += lengths[i]
        if total > most and i > start:
            yield start, i
            start, total = i, lengths[i]
    if start < n:
        yield start, n
