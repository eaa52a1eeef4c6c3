"""Token ids of whole texts by a public tokenizer file, with a cache of words."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release

#: Words held in a worker's cache before it is emptied.
CACHE_WORDS = 300_000
#: ASCII punctuation but the apostrophe, which may begin an ending like 's.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that the file's rules keep whole: Latin letters in lower case, composed.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")
#: The rules under which words can be encoded apart (fixed values of the word-level file).
_NORMAL = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_loaded: dict[str, tuple] = {}  # tokenizer, model, cache, whether words can be encoded apart, added tokens


def by_words(rules: dict) -> bool:
    """Whether a tokenizer file's rules are those that ``encode`` may apply word by word."""
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    parts = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = [s["type"] for s in steps] == _NORMAL and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    split = [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _SPLIT} and not parts[1]["add_prefix_space"]
    raw = not any(a["normalized"] for a in rules.get("added_tokens") or [])  # added tokens are then looked for in the text as it is
    return raw and plain and split and not rules.get("post_processor") and (rules.get("model") or {}).get("type") == "BPE"


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTES = _byte_letters()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _load(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        _loaded[path] = (t, t.model, {}, by_words(rules), [a["content"] for a in rules.get("added_tokens") or []])
        del rules
        release()  # the parsed file is large
    return _loaded[path]


def _ids_of(words: list[str], path: str) -> list[bytes]:
    """Little-endian ids of words without ASCII white space, A-Z in lower case.

    Punctuation after a Latin letter or a digit, in lower case too, is a run of its own under the
    file's rules, so it is encoded apart, which leaves far fewer distinct words. Other scripts
    have letters that are younger than the library's tables. Plain ones go to the merging
    model directly; all others take the whole way through the tokenizer.
    """
    tokenizer, model, cache, _, _ = _load(path)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    out = []
    for w in words:
        found = cache.get(w)
        if found is None:
            core = w.rstrip(_MARKS)
            tail = w[len(core) :]
            last = core[-1:].lower()[-1:]  # a capital may end in a mark in lower case, which joins the punctuation
            if tail and (_PLAIN.fullmatch(last) or last in tuple("0123456789")):
                found = b"".join(_ids_of([core, tail], path))
            else:
                if _PLAIN.fullmatch(w) and w.lower() == w:
                    letters = w if w.isascii() else "".join(_BYTES[b] for b in w.encode())
                    ids = [t.id for t in model.tokenize(letters)]
                else:
                    ids = tokenizer.encode(w, add_special_tokens=False).ids
                found = cache[w] = np.array(ids, "<u4").tobytes()
        out.append(found)
    return out


def forget() -> None:
    """Empty the caches, at the end of a task."""
    for _, _, cache, _, _ in _loaded.values():
        cache.clear()


def _whole(texts: list[str | None], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    each = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4") for t in texts]
    return np.concatenate([np.empty(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array (uint32), and each text's first place (n + 1 offsets).

    The file's rules never join two words across ASCII white space, so a text's ids are those of
    its words one after another, and each distinct word is encoded once. Null is an empty text.
    Texts that hold an added token, like the one for the end of a text, are encoded whole, as the
    library finds these tokens before its rules apply; so are all texts for a file of other rules.
    """
    tokenizer, _, _, apart, added = _load(path)
    texts = pc.fill_null(texts, "")
    whole = np.full(len(texts), not apart)
    for a in added:
        whole |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False).astype(bool)
    tokenizer.encode_special_tokens = False
    flat, sizes = _whole(texts.filter(pa.array(whole)).to_pylist(), tokenizer)
    if whole.all():
        return flat, np.r_[0, np.cumsum(sizes)]
    ids, at = _by_words(texts.filter(pa.array(~whole)) if whole.any() else texts, path)
    if not whole.any():
        return ids, at
    n = np.empty(len(texts), np.int64)
    n[whole], n[~whole] = sizes, np.diff(at)
    out, of_whole = np.empty(int(n.sum()), "<u4"), np.repeat(whole, n)
    out[of_whole], out[~of_whole] = flat, ids
    return out, np.r_[0, np.cumsum(n)]


def _by_words(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """As ``encode``, for texts without added tokens; what becomes one in lower case is ordinary text."""
    _load(path)[0].encode_special_tokens = True
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    starts = words.offsets.to_numpy().astype(np.int64)
    coded = words.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    parts = _ids_of(coded.dictionary.to_pylist(), path)
    flat = np.frombuffer(b"".join(parts), "<u4")
    size = np.fromiter((len(x) // 4 for x in parts), np.int64, len(parts))
    begin = np.cumsum(size) - size
    codes = coded.indices.to_numpy()
    n = size[codes]
    ends = np.cumsum(n)
    ids = flat[np.repeat(begin[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    return ids, np.r_[0, ends][starts - starts[0]]
