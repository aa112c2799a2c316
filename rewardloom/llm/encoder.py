"""Token ids of whole texts by a file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that Python takes for white space and the tokenizers' patterns do not.
_ODD = re.compile("[\x1c-\x1f]")
_WITH_SPACE = re.compile(r"\s*\S+|\s+")
_WITH_SPACE_ODD = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
#: White space before a space. Texts without it, most of them, are cut at single spaces.
_ROUGH = tuple(f"{chr(c)} " for c in range(0x3001) if chr(c).isspace())
_NO_SPACE_ODD = re.compile("[\\S\x1c-\x1f]+")
#: For Arrow's RE2: texts that are not cut at single spaces, and words that do not begin and end with something visible.
_BLANK = "[" + "".join(f"\\x{{{ord(r[0]):x}}}" for r in _ROUGH) + "]"
_NOT_CUT = rf"\A(?: |\z)|{_BLANK} |[\x1c-\x1f]"
_NOT_WORD = rf"\A(?:{_BLANK}|\z)|{_BLANK}\z"
#: The only steps before the model whose pieces of such words are known here: letters in lower case, then the marks.
_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
_TWO_PIECES = r"\A(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-/:-@\[-`{-~]*)\z"
MARKS = frozenset(",.;:!?")
REMEMBERED = 80 << 20  # bytes, about, of the chunks whose ids a worker keeps, and as many of older ones
COST = 180  # bytes of an entry besides its letters and ids
LONGEST = 48  # code points of a chunk that is kept
BLOCK = 12 << 20  # bytes, about, of texts whose distinct words are encoded together
AT_ONCE = 2048  # bytes, about, of words that the library gets as one text
KEPT = 16 << 20  # bytes of such words and their ids that a worker keeps for the next block
_NO_WORDS, _NO_IDS = pa.array([], pa.string()), pa.array([], pa.list_(pa.uint32()))


def _lists(ids: np.ndarray, sizes: np.ndarray | list[int]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.uint32()), type=pa.list_(pa.uint32()))


def _gathered(ids: pa.Array, chosen: np.ndarray, begins: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of each text: ``chosen`` are the numbers of all words, ``begins`` where a text's first one stands."""
    counts = np.add.reduceat(pc.list_value_length(ids).to_numpy()[chosen], begins, dtype=np.int64)
    yield from np.split(ids.take(pa.array(chosen)).flatten().to_numpy(), np.cumsum(counts)[:-1])


def vocabulary_path(name: str) -> str:
    """Path of a public tokenizer file; any other path may be passed to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Chunks(dict):
    """Ids of a chunk as bytes, made the first time it is asked for; ``lead`` stands before every chunk.

    A chunk that is one run of letters, perhaps after a space, is one piece for both kinds of tokenizer, and a
    punctuation mark after it is the next piece; such chunks skip the library's pre-tokenizer, whose letters-to-symbols
    table is asked for once per character. Every other chunk goes through the library's own steps.
    """

    def __init__(self, tokenizer, limit: int, lead: str = "", plain: _Chunks | None = None):
        super().__init__()
        self._normalizer, self._pre, self._model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model
        self._older: dict[str, bytes] = {}
        self._symbols = _Symbols(tokenizer.pre_tokenizer)
        self._lead, self._plain, self._size, self._limit = lead, plain, 0, limit
        self.space = self._symbols[32]
        self._same = all(self._symbols[ord(c)] == c for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def __missing__(self, chunk: str) -> bytes:
        older = self._older
        ids = older.get(chunk)
        if ids is None:
            if self._lead and len(chunk.split()) > 1:  # other white space inside: cut there, and keep the parts
                first, *rest = _WITH_SPACE.findall(chunk)
                plain = self._plain
                return self[first] + b"".join([plain[part] for part in rest])
            if chunk[-1:] in MARKS and chunk[:-1] and self._letters(chunk[:-1]):
                ids = self[chunk[:-1]] + (self[chunk[-1]] if self._plain is None else self._plain[chunk[-1]])
            else:
                ids = self._make(self._lead + chunk)
            if len(chunk) > LONGEST:
                return ids
        self._size += COST + len(chunk) + len(ids)
        if self._size > self._limit:
            self._older = dict(self)
            self.clear()
            self._size = COST + len(chunk) + len(ids)
        self[chunk] = ids
        return ids

    def _normal(self, text: str) -> str:
        if self._normalizer is None:
            return text
        return text.lower() if text.isascii() else self._normalizer.normalize_str(text)

    def _letters(self, chunk: str) -> bool:
        """Whether the chunk is a run of letters, perhaps after a space, as the patterns see it."""
        text = self._normal(self._lead + chunk)
        return (text[1:] if text[:1] == " " else text).isalpha()

    def _make(self, chunk: str) -> bytes:
        text = self._normal(chunk)
        if (text[1:] if text[0] == " " else text).isalpha():
            text = text.replace(" ", self.space) if self._same and text.isascii() else text.translate(self._symbols)
            return array("I", [token.id for token in self._model.tokenize(text)]).tobytes()
        text = self._normalizer.normalize_str(chunk) if self._normalizer else chunk
        pieces = self._pre.pre_tokenize_str(text)
        return array("I", [token.id for piece, _ in pieces for token in self._model.tokenize(piece)]).tobytes()


class _Symbols(dict):
    """The symbols a pre-tokenizer writes for a character, by code point; a table for ``str.translate``."""

    def __init__(self, pre_tokenizer):
        super().__init__()
        self._pre = pre_tokenizer

    def __missing__(self, code: int) -> str:
        self[code] = "".join(piece for piece, _ in self._pre.pre_tokenize_str(chr(code)))
        return self[code]


def kept_encoder(path: str, spaces: bool, remembered: int | None = None) -> Encoder:
    """The encoder of this Python worker, so that the tasks it runs one after the other share what they remember."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    kept = sys.modules.setdefault("_rewardloom_encoders", ModuleType("_rewardloom_encoders")).__dict__
    key = f"{path}|{spaces}|{remembered}"
    if key not in kept:
        kept[key] = Encoder(path, spaces, remembered)
    return kept[key]


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers, the same as ``Tokenizer.encode``.

    Both kinds of tokenizer used here cut every text before white space that follows other text, and no rule looks
    across such a cut. So a text is cut there and each distinct chunk goes through the library's normalizer,
    pre-tokenizer and model once, which saves most of the work. The strings of the file's added tokens have ids of
    their own, and the text between them is encoded part by part. A file whose added tokens ask for more than their
    plain string is left to the library. ``spaces``: whether white space belongs to the chunk after it, or is dropped
    by the tokenizer. ``remembered``: bytes of chunks that are kept, and as many of older ones; texts of at most a
    sixth of it are worked on together, and words of at most half of it are known to the next ones.
    """

    def __init__(self, path: str, spaces: bool, remembered: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._spaces = spaces
        limit = REMEMBERED if remembered is None else remembered
        self._chunks = _Chunks(self.tokenizer, limit)
        self._spaced = _Chunks(self.tokenizer, limit, " ", self._chunks)
        added = self.tokenizer.get_added_tokens_decoder()
        self._plain = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        self._added = {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        self._cuts = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")")
        self._leads, self._ends = (self._begin_words(), None) if spaces else (None, self._end_pieces())
        self._block_bytes, self._kept = max(1, min(BLOCK, limit // 6)), min(KEPT, limit // 2)
        self._known, self._known_ids = _NO_WORDS, _NO_IDS

    def _begin_words(self) -> np.ndarray | None:
        """By id, whether a token begins with a space; None where words cannot be told apart by that."""
        from tokenizers import models, pre_tokenizers

        whole, model, pre = self.tokenizer, self.tokenizer.model, self.tokenizer.pre_tokenizer
        if not isinstance(model, models.BPE) or not isinstance(pre, pre_tokenizers.ByteLevel) or pre.add_prefix_space or not pre.use_regex:
            return None
        if model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix:
            return None
        if whole.normalizer or whole.truncation or whole.padding or not self._plain or any(" " in string for string in self._added):
            return None
        vocabulary, space = whole.get_vocab(with_added_tokens=False), self._spaced.space
        leads = np.zeros(max(vocabulary.values()) + 1, bool)
        leads[[k for token, k in vocabulary.items() if token.startswith(space)]] = True
        return leads if space in vocabulary else None

    def _end_pieces(self) -> np.ndarray | None:
        """By id, whether a token ends a piece; None where pieces cannot be told apart by that or are not known here."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        whole, model = self.tokenizer, self.tokenizer.model
        if not isinstance(model, models.BPE) or not whole.normalizer or not whole.pre_tokenizer:
            return None
        if json.loads(whole.normalizer.__getstate__()) != {"type": "Sequence", "normalizers": _NORMALIZER}:
            return None
        if json.loads(whole.pre_tokenizer.__getstate__()) != {"type": "Sequence", "pretokenizers": _PRE_TOKENIZER}:
            return None
        suffix = model.end_of_word_suffix
        if model.dropout or model.unk_token or model.continuing_subword_prefix or model.ignore_merges or not suffix:
            return None
        if whole.truncation or whole.padding or not self._plain:
            return None
        vocabulary = whole.get_vocab(with_added_tokens=False)
        if not all(s in vocabulary and s + suffix in vocabulary for s in pre_tokenizers.ByteLevel.alphabet()):
            return None  # the model would leave a symbol out
        self._pieces = Tokenizer(model)
        self._pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self._as_symbols = {c: chr(c) if c < 128 else byte_level.pre_tokenize_str(chr(c))[0][0] for c in range(256)}
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, none of them null, the same as from ``encode``.

        With the kinds of file known here, words of many texts are cut and numbered by Arrow, each distinct one goes
        through the library once, many in one call, and the ids are gathered by number. Words of earlier blocks are
        known, within ``KEPT`` bytes.
        """
        if (self._leads is None and self._ends is None) or not len(texts):
            for text in texts:  # one text at a time
                yield np.frombuffer(self.encode(text.as_py()), "<u4")
            return
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        blocks = int(sizes[-1]) // self._block_bytes + 1
        edges = [0, *np.searchsorted(sizes, sizes[-1] * np.arange(1, blocks) / blocks).tolist(), len(texts)]
        for begin, end in zip(edges, edges[1:]):
            block = texts.slice(begin, end - begin).cast(pa.string())
            other = pc.match_substring_regex(block, _NOT_CUT) if self._spaces else pa.array(np.zeros(len(block), bool))
            for string in self._added:
                other = pc.or_(other, pc.match_substring(block, string))
            coded = (self._block if self._spaces else self._pieces_block)(block.filter(pc.invert(other)))
            for text, alone in zip(block, other.to_pylist()):
                yield np.frombuffer(self.encode(text.as_py()), "<u4") if alone else next(coded)
            del block, coded
            pa.default_memory_pool().release_unused()  # else the peak of a block stays with the worker

    def _block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of texts in which every space but at the end begins a word."""
        if not len(texts):
            return
        words = pc.split_pattern(texts, " ")
        begins = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
        numbered = words.flatten().dictionary_encode()
        first = words.flatten().take(pa.array(begins)).dictionary_encode()
        odd = pc.match_substring_regex(numbered.dictionary, _NOT_WORD).to_numpy(zero_copy_only=False)
        plain = numbered.dictionary.filter(pa.array(~odd))
        places = self._places(plain)
        alone = [self._spaced[word] for word in numbered.dictionary.filter(pa.array(odd)).to_pylist()]
        alone += [self._first(word) for word in first.dictionary.to_pylist()]
        ids = pa.concat_arrays([self._known_ids, _lists(np.frombuffer(b"".join(alone), "<u4"), [len(a) // 4 for a in alone])])
        number, known = np.empty(len(odd), np.int64), len(self._known)
        number[~odd], number[odd] = places, np.arange(known, known + odd.sum())
        chosen = number[numbered.indices.to_numpy()]
        chosen[begins] = known + odd.sum() + first.indices.to_numpy()
        self._keep(plain, places)
        yield from _gathered(ids, chosen, begins)

    def _pieces_block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of texts for a tokenizer that drops white space: what stands between spaces are words, each on its own.

        A word of Latin letters and ASCII marks is put together from its two pieces, so that words need not be known
        with each mark. Every other word, also one with other white space inside, is encoded alone.
        """
        if not len(texts):
            return
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        begins = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
        numbered = words.flatten().dictionary_encode()
        del words
        parts = pc.extract_regex(numbered.dictionary, _TWO_PIECES)
        odd = pc.is_null(parts).to_numpy(zero_copy_only=False)
        alone = [self._ordinary(word) for word in numbered.dictionary.filter(pa.array(odd)).to_pylist()]
        parts = parts.filter(pa.array(~odd))
        pieces = pa.concat_arrays([pc.utf8_lower(parts.field("letters")), parts.field("marks")])
        there = pc.not_equal(pieces, "").to_numpy(zero_copy_only=False)
        pieces = pieces.filter(pa.array(there)).dictionary_encode()
        places = self._places(pieces.dictionary)
        chosen = np.full(2 * len(parts), -1)
        chosen[there] = places[pieces.indices.to_numpy()]
        chosen = chosen.reshape(2, -1).T  # by word: its letters, its marks
        sizes = np.append(pc.list_value_length(self._known_ids).to_numpy(), 0)[chosen].sum(1)
        own = self._known_ids.take(pa.array(chosen[chosen >= 0])).flatten().to_numpy()
        self._keep(pieces.dictionary, places)
        ids = _lists(np.concatenate([own, np.frombuffer(b"".join(alone), "<u4")]), np.concatenate([sizes, [len(a) // 4 for a in alone]]))
        number = np.empty(len(odd), np.int32)
        number[~odd], number[odd] = np.arange(len(parts)), np.arange(len(parts), len(odd))
        number = number[numbered.indices.to_numpy()]
        del numbered, parts, pieces, chosen, own
        yield from _gathered(ids, number, begins)

    def _keep(self, words: pa.Array, places: np.ndarray) -> None:
        """Of the known words those of the last block alone, or none, when they are too many."""
        if self._known.nbytes + self._known_ids.nbytes > self._kept:
            self._known, self._known_ids = words, self._known_ids.take(pa.array(places))
            if self._known.nbytes + self._known_ids.nbytes > self._kept:
                self._known, self._known_ids = _NO_WORDS, _NO_IDS

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where distinct words are among the known ones; those that are not there are added."""
        places = pc.fill_null(pc.index_in(words, self._known), -1).to_numpy().astype(np.int64)
        new = words.filter(pa.array(places < 0))
        places[places < 0] = np.arange(len(self._known), len(self._known) + len(new))
        self._known, self._known_ids = pa.concat_arrays([self._known, new]), pa.concat_arrays([self._known_ids, self._together(new)])
        return places

    def _together(self, words: pa.Array) -> pa.Array:
        """Ids of each word with a space before it, or of each piece, many to a call of the library."""
        group = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64) // AT_ONCE
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(words)]]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), words), " ").to_pylist()
        if self._ends is not None:
            joined = [some if some.isascii() else some.translate(self._as_symbols) for some in joined]
        library, lead = (self._pieces, "") if self._ends is not None else (self.tokenizer, " ")
        coded = [library.encode_batch_fast([lead + some], add_special_tokens=False)[0].ids for some in joined if some]
        ids = np.concatenate([np.empty(0, "<u4"), *[np.array(c, "<u4") for c in coded]])
        if self._ends is not None:
            begins = np.flatnonzero(np.append(True, self._ends[ids]))[:-1]
        else:
            begins = np.flatnonzero(self._leads[ids])
        if len(begins) != len(words):
            raise ValueError("tokens do not begin where words do")
        return _lists(ids, np.diff(begins, append=len(ids)))

    def encode(self, text: str) -> bytes:
        if not self._plain:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        for string in self._added:
            if string in text:
                parts = self._cuts.split(text)  # every second part is an added token
                return b"".join([self._added[p] if k % 2 else self._ordinary(p) for k, p in enumerate(parts)])
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        odd = _ODD.search(text)
        if self._spaces and not odd and text and not text.isspace() and text[0] != " " and not any(r in text for r in _ROUGH):
            # No white space before a space: every space but at the end begins a word.
            first, *words = text.split(" ")
            known = self._spaced
            return self._first(first) + b"".join([known[word] for word in words])
        if self._spaces:
            chunks = (_WITH_SPACE_ODD if odd else _WITH_SPACE).findall(text)
        else:
            chunks = _NO_SPACE_ODD.findall(text) if odd else text.split()
        known = self._chunks
        return b"".join([known[chunk] for chunk in chunks])

    def _first(self, text: str) -> bytes:
        return b"".join([self._chunks[chunk] for chunk in _WITH_SPACE.findall(text)])
