"""Token ids of whole texts with public vocabularies, through the `tokenizers` library.

A vocabulary here never joins characters across a white-space boundary, so a text is cut at such boundaries, each
distinct piece is encoded once and its ids are reused. Texts whose words are parted by single blanks and newlines are cut
and numbered column-wise by Arrow, the others one by one; ids are then laid out by numbers. `tests/llm/test_tokens.py` holds the ids against the
library's own encoding of whole texts.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode White_Space, as the vocabularies' patterns understand `\s`.
_SPACE = "\t-\r \x85\xa0  -     　"
#: White space other than blank and newline, and the control characters that only Python counts as space.
_RARE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")
_WITH_SPACE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORDS = re.compile(f"[^{_SPACE}]+")
#: A newline, letters, and ASCII marks without an apostrophe: every vocabulary here cuts between them.
_STEM = re.compile(r"(\n?)( ?[^\W\d_]+)([!-&(-/:-@[-`{-~]*)")

#: For Arrow's expressions: white space beyond ASCII; with joined blanks, also whatever is not one blank or newline between words.
_WIDE = "[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_UNEVEN = "  |\n\n| \n|\n |^[ \n]|[ \n]$|[\t\x0b-\r]|" + _WIDE

#: Pieces of letters that no vocabulary here normalises or cuts: lower case alone where the vocabulary lower-cases.
_PLAIN = {True: re.compile(" [A-Za-zÀ-ÖØ-öø-ÿ]+"), False: re.compile("[a-zß-öø-ÿ]+")}

#: Pieces kept for reuse in one Python worker; a bound on its memory and of no influence on the ids.
KEPT_PIECES = 200_000
#: Text of one call: its pieces are made distinct together.
CALL_BYTES = 4 << 20
END_ID = 1


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; `end_id` ends each document.

    keeps_space: the vocabulary joins a blank to the word after it; else white space only separates words.
    """

    def __init__(self, path: str, keeps_space: bool, kept: int = KEPT_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_space, self.kept, self.cache = keeps_space, kept, {}
        # The same model without normalisation and patterns, for plain pieces; some of its ids mark a piece's end or start.
        bytes_ = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = Tokenizer(self.tokenizer.model)  # shared, not a copy
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next") if keeps_space else pre_tokenizers.WhitespaceSplit(), bytes_])
        known = self.plain.get_vocab()
        self.marks = np.zeros(max(known.values()) + 1, bool)
        self.marks[[i for x, i in known.items() if (x.startswith("Ġ") if keeps_space else x.endswith("</w>"))]] = True

    def pieces(self, text: str) -> list[str]:
        if _RARE.search(text):
            return (_WITH_SPACE if self.keeps_space else _WORDS).findall(text)
        if not self.keeps_space:
            return text.split()
        if "  " in text or "\n\n" in text or " \n" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
            return _WITH_SPACE.findall(text)
        if "\n " in text:
            return _WITH_SPACE.findall(text)
        # From here on every white space is one blank or newline between two words.
        first, *rest = text.replace("\n", " \n").split(" ")
        return [first, *[x if x[0] == "\n" else " " + x for x in rest]]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, with the end id; null counts as empty."""
        ids, ends = self.encode_column(pa.array(list(texts), pa.large_string()))
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text with the end id, and the offsets between texts."""
        column = column.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(column, _UNEVEN if self.keeps_space else _WIDE).to_numpy(zero_copy_only=False)
        if self.keeps_space:
            odd |= pc.equal(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        even, uneven = np.flatnonzero(~odd), np.flatnonzero(odd)
        cut, names = self._cut(column.filter(pa.array(~odd)))
        number: dict[str, int] = {}
        lists = [self.pieces(t) if t else [] for t in column.take(pa.array(uneven)).to_pylist()]
        more = np.fromiter((number.setdefault(x, len(number)) for y in lists for x in y), np.int64) + len(names)
        data, start, size = self._coded([*names, *number])
        # Pieces of even texts, then those of the others; each text's own stretch ends with the end id, the last piece.
        piece = np.concatenate([cut[0], more])
        counts, begins = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        counts[even], begins[even] = np.diff(cut[1]), cut[1][:-1]
        counts[uneven] = [len(x) for x in lists]
        begins[uneven] = len(cut[0]) + np.r_[0, np.cumsum(counts[uneven])[:-1]].astype(np.int64)
        whole = np.full(int(counts.sum()) + len(column), len(start) - 1, np.int64)
        bounds = np.r_[0, np.cumsum(counts + 1)]
        shift = np.arange(int(counts.sum()))
        base = np.r_[0, np.cumsum(counts)]
        whole[shift + np.repeat(bounds[:-1] - base[:-1], counts)] = piece[shift + np.repeat(begins - base[:-1], counts)]
        sizes = size[whole]
        ends = np.r_[0, np.cumsum(sizes)]
        at = np.repeat(start[whole] - ends[:-1], sizes)
        at += np.arange(len(at))
        ids = data[at]
        return ids, ends[bounds]

    def _cut(self, column: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], list[str]]:
        """Numbers of the pieces of even texts, the offsets between texts, and the pieces that the numbers stand for."""
        if not len(column):
            return (np.empty(0, np.int64), np.zeros(1, np.int64)), []
        if self.keeps_space:
            words = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        else:
            words = pc.ascii_split_whitespace(pc.ascii_lower(column))  # the vocabulary has lower case alone
        off = words.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        found = words.flatten().dictionary_encode()
        piece, names = found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()
        if self.keeps_space:
            # A text's first word has no blank before it.
            first, at = np.unique(piece[off[:-1]], return_inverse=True)
            piece[off[:-1]] = len(names) + at
            names = [x if x[0] == "\n" else " " + x for x in names] + [names[i] for i in first]
        elif "" in names:  # where a text begins or ends with white space
            full = piece != names.index("")
            piece, off = piece[full], np.r_[0, np.cumsum(full)][off]
        return (piece, off), names

    def _coded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, with the end id as one more piece, and each piece's place and size."""
        coded = list(map(self.cache.get, pieces))
        places = [i for i, x in enumerate(coded) if x is None]
        new = [pieces[i] for i in places]
        parts = {x: p for x in new if (x[:1] == "\n" or not x[-1:].isalpha()) and (m := _STEM.fullmatch(x)) and len(p := [y for y in m.groups() if y]) > 1}
        unseen = [x for x in new if x not in parts]
        unseen += {y for p in parts.values() for y in p if y not in self.cache}.difference(unseen)
        known = dict(zip(unseen, self._ids(unseen), strict=True))
        get = lambda x: known[x] if x in known else self.cache[x]
        known.update({x: b"".join(map(get, p)) for x, p in parts.items()})
        for i, x in zip(places, map(known.__getitem__, new), strict=True):
            coded[i] = x
        coded.append(END_ID.to_bytes(4, "little"))
        if len(self.cache) + len(known) <= self.kept:
            self.cache.update(known)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return np.frombuffer(b"".join(coded), "<u4"), np.r_[0, np.cumsum(size)[:-1]], size

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        fits = _PLAIN[self.keeps_space].fullmatch
        plain = [i for i, x in enumerate(pieces) if fits(x)]
        groups = [plain[a : a + 256] for a in range(0, len(plain), 256)]
        coded = self.plain.encode_batch_fast([("" if self.keeps_space else " ").join(pieces[i] for i in g) for g in groups], add_special_tokens=False)
        rest = sorted(set(range(len(pieces))).difference(plain))
        for group, e in zip(groups, coded, strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(self.marks[ids])
            if len(at) != len(group):
                rest += group
                continue
            cuts = (4 * (np.r_[at, len(ids)] if self.keeps_space else np.r_[0, at + 1])).tolist()
            raw = ids.tobytes()
            for i, x, y in zip(group, cuts[:-1], cuts[1:], strict=True):
                out[i] = raw[x:y]
        for i, x in zip(rest, self._joined([pieces[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Encodes many pieces in one call: between them stands a separator that is an id of its own."""
        mark, space = ("\n", "") if self.keeps_space else ("7", " ")
        out: list[bytes] = [b""] * len(pieces)
        plain = [i for i, x in enumerate(pieces) if mark not in x and (not self.keeps_space or not x[0].isspace() or x[0] == " " and not x.isspace())]
        alone = sorted(set(range(len(pieces))).difference(plain)) if len(plain) < len(pieces) else []
        mark_id = self.tokenizer.encode(mark, add_special_tokens=False).ids
        for a in range(0, len(plain), 64):
            group = plain[a : a + 64]
            joined = f"{space}{mark}{space}".join(pieces[i] for i in group)
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == mark_id[0])
            if len(mark_id) != 1 or len(cuts) != len(group) - 1:
                alone += group
                continue
            for i, x, y in zip(group, np.r_[0, cuts + 1].tolist(), np.r_[cuts, len(ids)].tolist(), strict=True):
                out[i] = ids[x:y].tobytes()
        for i, e in zip(alone, self.tokenizer.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, dtype="<u4").tobytes()
        return out


@functools.cache
def encoder(name: str) -> PieceEncoder:
    """The encoder of a file of `public_tokenizers`, one for each Python worker. A path may stand instead of the name."""
    import public_tokenizers

    path = name if os.path.sep in name else public_tokenizers.path(name)
    return PieceEncoder(path, keeps_space="byte" in os.path.basename(path))
