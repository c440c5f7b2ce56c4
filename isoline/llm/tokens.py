"""Tokenizers by path, encoded word by word.

The three tokenizers split words before merging, so a text's ids are its words' ids one after the other. Words are
cut only where that holds for certain; whatever is unusual stays in one longer word and is left to the library.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from isoline.llm.words import spread

#: Largest code point of letters whose class no Unicode version has changed; words are only taken apart below it.
_LATIN = 0x250
_LATIN_END = chr(_LATIN)
#: White space that Python and the tokenizer libraries might see differently.
_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_BEYOND_LATIN = re.compile(r"[\x1c-\x1f\x85\xa0\u0130\u0250-\U0010ffff]")
_MESSY = re.compile(r"\s\s|[^\S \n]|\x00|^\s|\s\Z")
_CLEAN_CUT = re.compile(r"(?<=\S)(?= \S)")
_LOADED: dict[tuple, object] = {}


def _letter(c: str) -> bool:
    return c.isalpha() and ord(c) < _LATIN and c != "\u0130"  # whose small form ends with a mark


def load(path: str):
    """A tokenizer of the tokenizers library, truncation and padding off; loaded once per process."""
    if ("t", path) not in _LOADED:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED["t", path] = t
    return _LOADED["t", path]


#: Signs that end words; a run of them after a letter is one unit to the tokenizers.
_SIGNS = ".,;:!?$%&*#+-=@~^/)]}\""


def tail_at(word: str) -> int:
    """Where a run of signs at the end of a word starts if it stands after a letter, where the tokenizers always cut;
    else 0."""
    n = len(word.rstrip(_SIGNS))
    return n if 1 < n < len(word) and _letter(word[n - 1]) else 0


def _edges(path: str) -> tuple[bool, np.ndarray]:
    """Whether words end with a suffix (else they start with their space), and which ids do so."""
    if ("e", path) not in _LOADED:
        t = load(path)
        suffix = getattr(t.model, "end_of_word_suffix", None)
        names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        _LOADED["e", path] = (bool(suffix), np.array([n.endswith(suffix) if suffix else n.startswith("\u0120") for n in names]))
    return _LOADED["e", path]


def encode_flat(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of distinct words one after the other, number of ids of each), by the library.

    Words of plain Latin letters are encoded as one text: each is one unit to the tokenizer, and its first or last
    piece shows where it ends. All others go in one by one, as separate inputs of a single call.
    """
    t = load(path)
    ends, edge = _edges(path)
    plain, other = [], []
    for k, w in enumerate(words):
        core = w if ends else w[1:]
        (plain if core.isalpha() and max(core) < _LATIN_END and "\u0130" not in core and (ends or w[0] == " ") else other).append(k)
    ids: list[np.ndarray] = []
    lens = np.zeros(len(words), np.int64)
    if plain:
        text = (" " if ends else "").join([words[k] for k in plain])
        flat = np.array(t.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(edge[flat])
        size = np.diff(np.append(-1, at)) if ends else np.diff(np.append(at, len(flat)))
        if len(size) != len(plain):
            raise ValueError("the tokenizer cuts within words of letters")
        lens[plain] = size
        ids.append(flat)
    if other:
        found: list[list[int]] = [[] for _ in other]
        simple = [k for k, w in enumerate(other) if words[w] and "<|" not in words[w]]
        if simple:
            enc = t.encode([words[other[k]] for k in simple], is_pretokenized=True, add_special_tokens=False)
            for i, k in zip(enc.ids, enc.word_ids, strict=True):
                found[simple[k]].append(i)
        for k, w in enumerate(other):
            if "<|" in words[w]:
                found[k] = t.encode(words[w], add_special_tokens=False).ids
        lens[other] = [len(f) for f in found]
        ids.append(np.fromiter((i for f in found for i in f), np.uint32))
    order = np.array(plain + other, np.int64)
    start = np.empty(len(words), np.int64)
    start[order] = np.cumsum(lens[order]) - lens[order]
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32))[spread(start, lens)], lens


def encode_words(path: str, words: list[str]) -> list[np.ndarray]:
    """Ids of each distinct word; signs at the end of words are encoded once for all."""
    code: dict[str, int] = {}
    parts = []
    for w in words:
        n = tail_at(w)
        parts.append([code.setdefault(p, len(code)) for p in ((w[:n], w[n:]) if n else (w,))])
    flat, lens = encode_flat(path, list(code))
    at = np.split(flat, np.cumsum(lens)[:-1]) if len(lens) else []
    return [at[p[0]] if len(p) == 1 else np.concatenate([at[i] for i in p]) for p in parts]


def split_dropping_space(text: str) -> list[str]:
    """Words for a tokenizer that drops white space and lower-cases.

    Texts of plain Latin signs are lower-cased here, which makes fewer words; others are cut at plain spaces only and
    left as they are.
    """
    if _BEYOND_LATIN.search(text):
        return [w for w in re.split(r"[ \t\n\r]+", text) if w]
    return text.lower().split()


def split_keeping_space(text: str) -> list[str]:
    """Words for a byte-level tokenizer, with their leading space; joined they are the text again."""
    if _MESSY.search(text):
        return [w for w in _CLEAN_CUT.split(text) if w]
    return [w for w in text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if w]


def pieces(path: str) -> pa.Array:
    """Bytes of each id of a byte-level vocabulary: the id-to-piece table, as large as the vocabulary."""
    if ("p", path) not in _LOADED:
        t = load(path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {i: x.content for i, x in t.get_added_tokens_decoder().items()}
        _LOADED["p", path] = pa.array([added[i].encode() if i in added else bytes(back[c] for c in t.id_to_token(i)) for i in range(t.get_vocab_size())], pa.large_binary())
    return _LOADED["p", path]


def load_pieces(path: str):
    """A sentencepiece processor, and whether its vocabulary allows cuts before a space that follows another sign."""
    if ("s", path) not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        crosses = any(re.search("[^\u2581]\u2581", sp.id_to_piece(i)) for i in range(sp.get_piece_size()))
        probe = "a  b c"
        same = sp.encode(probe) == [*sp.encode("a"), *sp.encode(" b"), *sp.encode("c")]
        _LOADED["s", path] = (sp, not crosses and same)
    return _LOADED["s", path]


def split_pieces(text: str, safe: bool) -> list[str]:
    """Words for sentencepiece, without the one space that its dummy prefix restores; unusual texts stay whole."""
    if not safe or "\u2581" in text or "\0" in text or not text or _ODD_SPACE.search(text):
        return ["\0" + text]
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    tail = len(text) - len(text.rstrip(" "))
    if tail == len(text):
        return ["\0" + text]
    out, run = [], 0
    for w in text[: len(text) - tail].split(" "):
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    if tail:
        last = out.pop()
        out.append(last + " " * tail)
    return out


def default_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def worker_state(key: tuple, make):
    """Something that lives as long as the Python worker."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]
