"""Plain Python forms of what the operators compute, for small tables."""

import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(_LOWER))


def lower(text):
    return (text or "").translate(_LOWER)


def remainder(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def grams(text, n=5):
    found = words(text)
    return {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def groups(names, linked):
    """The least name that each name is linked with."""
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in names}
