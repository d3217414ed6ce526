"""Token ids of whole texts, word by word.

Both vocabularies used here split a text into words before any merge. A single space before a visible character is always
such a split, and so is a line break between visible characters, and the end of letters before closing punctuation. Texts
are cut there, the library encodes each distinct piece once per worker, and the ids of a text are its pieces' ids joined.
The result equals one library call on the whole text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BREAK = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|\Z)")
_ODD_LINE = re.compile(r"(?:\A|\s)\n|\n(?:\s|\Z)")
# a space or line break with white space (any that either library counts) or an end of the text beside it
_BLANK = r"\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD_TEXT = rf" (?:[{_BLANK}]|\z)|(?:\A|[{_BLANK}])\n|\n(?:[{_BLANK}]|\z)"
_CLOSING = ".,;:!?*#$%&|)"
_GROUP = 64  # distinct pieces that one library call encodes together
_SLICE = 3 << 20  # characters of text whose arrays are held at a time; more where few other arrays are held


def pieces(text: str) -> list[str]:
    """The text cut at (and without) each space that a visible character follows."""
    return _BREAK.split(text) if _ODD.search(text) else text.split(" ")


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, with a bounded memo of pieces.

    ``spaced``: the vocabulary keeps the space in front of a word (byte-level merges) instead of dropping white space; pieces
    behind a space and pieces without one then have memos of their own. A memo has two generations of at most ``memo``
    pieces each; it only saves time.
    """

    def __init__(self, path: str, spaced: bool, memo: int = 200_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.library, self.spaced, self.memo, self.slice = Tokenizer.from_file(path), spaced, memo, _SLICE if spaced else 8 << 20
        self.bare: dict[str, bytes] = {}  # pieces as they stand
        self.after: dict[str, bytes] = {}  # pieces behind a space
        self.old: dict[bool, dict[str, bytes]] = {False: {}, True: {}}
        size = self.library.get_vocab_size(with_added_tokens=True)
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        self.model = self.library.model
        self.opens = np.array([n.startswith("Ġ") for n in names])
        self.ends = np.array([n.endswith("</w>") for n in names])
        self.line = self._ids(["\n"])[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, ids: np.ndarray, behind: bool) -> list[tuple[int, int]]:
        """Where the pieces of a group lie in its ids."""
        if not self.spaced:
            stops = np.flatnonzero(self.ends[ids]) + 1
            return list(zip([0, *stops[:-1]], stops, strict=True)) if len(stops) and stops[-1] == len(ids) else []
        if behind:
            starts = np.flatnonzero(self.opens[ids])
            return list(zip(starts, [*starts[1:], len(ids)], strict=True)) if len(starts) and starts[0] == 0 else []
        lines = np.flatnonzero(ids == self.line[0])
        return list(zip([0, *(lines + 1)], [*lines, len(ids)], strict=True))

    def _learn(self, wanted: set[str], into: dict[str, bytes], behind: bool) -> None:
        closed: dict[str, tuple[str, str]] = {}
        plain: set[str] = set()
        rest: list[str] = []
        for p in wanted:
            if p.isalpha():
                plain.add(p)
            elif (base := p.rstrip(_CLOSING)).isalpha() and base[-1].lower()[-1].isalpha():
                closed[p] = base, p[len(base) :]
                if base not in into:
                    plain.add(base)
            elif self.spaced and p and p.split() == [p]:
                plain.add(p)
            else:
                rest.append(p)
        # letters of ASCII are one word that the library's normaliser and splitter leave as it is, but for case
        lead, merged, order = "Ġ" if behind else "", self.model.tokenize, []
        for p in plain:
            if p.isascii() and p.isalpha():
                into[p] = array("I", [t.id for t in merged(lead + p if self.spaced else p.lower())]).tobytes()
            else:
                order.append(p)
        groups = [order[i : i + _GROUP] for i in range(0, len(order), _GROUP)]
        text = (lambda g: " " + " ".join(g)) if behind or not self.spaced else "\n".join
        for group, ids in zip(groups, self._ids([text(g) for g in groups]), strict=True):
            cuts = self._cuts(ids, behind)
            if len(cuts) != len(group):
                rest += group
                continue
            raw = ids.tobytes()
            for piece, (a, z) in zip(group, cuts, strict=True):
                into[piece] = raw[4 * a : 4 * z]
        for piece, ids in zip(rest, self._ids([" " + p if behind else p for p in rest]), strict=True):
            into[piece] = ids.tobytes()
        tails = list({t for _, t in closed.values() if t not in self.bare})
        for tail, ids in zip(tails, self._ids(tails), strict=True):
            self.bare[tail] = ids.tobytes()
        for p, (base, tail) in closed.items():
            into[p] = into[base] + self.bare[tail]

    def _provide(self, wanted: set[str], behind: bool) -> dict[str, bytes]:
        memo = self.after if behind else self.bare
        if len(memo) > self.memo:
            self.old[behind], memo = memo, {}
            if behind:
                self.after = memo
            else:
                self.bare = memo
        old, missing = self.old[behind], wanted - memo.keys()
        for piece in [p for p in missing if p in old]:
            memo[piece] = old[piece]
            missing.discard(piece)
        self._learn(missing, memo, behind)
        return memo

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the common case stays in arrays, only distinct pieces become Python strings."""
        out: list[bytes] = []
        at = size = 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= self.slice or k == len(texts) - 1:
                out += self._encode(texts[at : k + 1])
                at, size = k + 1, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD_TEXT).to_numpy(zero_copy_only=False) if self.spaced else np.zeros(len(texts), bool)
        out: list[bytes] = [b""] * len(texts)
        for k, ids in zip(np.flatnonzero(~odd).tolist(), self._arrays(column.filter(pa.array(~odd))), strict=True):
            out[k] = ids
        strange = np.flatnonzero(odd).tolist()
        for k, ids in zip(strange, self._encode_spaced([texts[k] for k in strange]) if strange else [], strict=True):
            out[k] = ids
        return out

    def _arrays(self, column: pa.Array) -> list[bytes]:
        if not len(column):
            return []
        if self.spaced:
            lines = pc.split_pattern(column, "\n")
            per_text = np.diff(lines.offsets.to_numpy())
            words = pc.split_pattern(lines.flatten(), " ")
        else:
            words = pc.split_pattern(pc.ascii_lower(pc.replace_substring(column, "\n", " ")), " ")
            per_text = np.ones(len(column), np.int64)
        per_line = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        piece, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        begins = np.zeros(len(piece), bool)
        begins[np.cumsum(per_line) - per_line] = True
        # numbers of pieces: behind a space, then as they stand, then the line break
        bare = begins if self.spaced else np.ones(len(piece), bool)
        piece[bare] += len(names)
        seen = np.zeros(2 * len(names), bool)
        seen[piece] = True
        used, stream = np.flatnonzero(seen), (np.cumsum(seen) - 1)[piece]
        split = int(np.searchsorted(used, len(names)))
        behind, plain = [names[i] for i in used[:split].tolist()], [names[i - len(names)] for i in used[split:].tolist()]
        after = self._provide(set(behind), True) if behind else {}
        stand = self._provide(set(plain), False)
        held = [after[p] for p in behind] + [stand[p] for p in plain] + [self.line.tobytes()]
        pool = np.frombuffer(b"".join(held), np.uint32)
        size = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        start = np.cumsum(size) - size
        last = np.cumsum(per_line)  # a line break follows each line but the last of its text
        inner = np.ones(len(per_line), bool)
        inner[np.cumsum(per_text) - 1] = False
        stream = np.insert(stream, last[inner], len(held) - 1)
        owner = np.repeat(np.arange(len(column)), np.add.reduceat(per_line, np.cumsum(per_text) - per_text) + per_text - 1)
        n = size[stream]
        stop = np.cumsum(n)
        raw = pool[np.repeat(start[stream] - (stop - n), n) + np.arange(int(stop[-1]))].tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, weights=n, minlength=len(column)).astype(np.int64))).tolist()
        return [raw[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    def _encode_spaced(self, texts: list[str]) -> list[bytes]:
        lines = [t.split("\n") if "\n" in t and not _ODD_LINE.search(t) else [t] for t in texts]
        cuts = [[pieces(x) for x in own] for own in lines]
        heads: set[str] = set()
        wanted: set[str] = set()
        for own in cuts:
            for c in own:
                heads.add(c[0])
                wanted.update(c[1:])
        after = self._provide(wanted, True).__getitem__
        bare = self._provide(heads, False)
        line = self.line.tobytes()
        return [line.join([b"".join([bare[c[0]], *map(after, c[1:])]) for c in own]) for own in cuts]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, spaced: bool) -> PieceEncoder:
    """One encoder per worker process and vocabulary file."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = PieceEncoder(path, spaced, 300_000 if spaced else 500_000)
    return _ENCODERS[path, spaced]
