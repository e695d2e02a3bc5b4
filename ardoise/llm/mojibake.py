"""UTF-8 text that was read as Latin-1 or Windows-1252: found run by run and read again."""

from __future__ import annotations

import re

# The characters that Windows-1252 puts where Latin-1 has controls, by their byte.
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_TAIL = "\x80-\xbf" + re.escape("".join(_CP1252))
_RUN = re.compile(f"(?:[\xc2-\xdf][{_TAIL}]|[\xe0-\xef][{_TAIL}]{{2}}|[\xf0-\xf4][{_TAIL}]{{3}})+")


def _decoded(run: str) -> str | None:
    try:
        return bytes(_CP1252.get(c, ord(c) if ord(c) < 256 else 256) for c in run).decode("utf-8")
    except ValueError:
        return None


def repair(text: str) -> tuple[str, list[int] | None]:
    """The text with every such run decoded, and the place in ``text`` of each of its characters
    (and of its end); the list is None where nothing was changed."""
    out, places, last, changed = [], [], 0, False
    for m in _RUN.finditer(text):
        fixed = _decoded(m[0])
        if fixed is None:
            continue
        changed = True
        out.append(text[last : m.start()])
        places.extend(range(last, m.start()))
        out.append(fixed)
        p = m.start()
        for c in fixed:
            places.append(p)
            p += len(c.encode("utf-8"))
        last = m.end()
    if not changed:
        return text, None
    out.append(text[last:])
    places.extend(range(last, len(text) + 1))
    return "".join(out), places
