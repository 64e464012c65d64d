"""The split of byte-level BPE vocabularies, compiled to a finite-state machine.

The pattern (contractions, letters, numbers, other signs, white space) is read
once as eight states over symbols of one character and what follows it.  A
block of text is cut into chunks; every chunk is run from all eight states at
once, which gives its state map with the number of pieces that begin in it.
The maps compose by a parallel prefix scan to each chunk's true entry state,
and a second run emits the piece starts.  The exit state of a block is the
entry state of the next, so a text of any length needs the memory of a block.
"""

from __future__ import annotations

import functools

import numpy as np

from attrix.llm.flat import BLOCK

CHUNK = 256
TAIL = 16
START, LETTERS, NUMBERS, OTHERS, BLANKS, JOINED, LAST_ONE, LAST_TWO = range(8)
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK = range(7)


def _members(pattern: str, text: str, engine: str) -> str:
    """The characters of ``text`` that match, by the regex engine of a tokenizer library."""
    if engine == "tiktoken":
        import tiktoken

        single = {bytes([b]): b for b in range(256)}  # what doesn't match gives no ids
        return bytes(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(text)).decode()
    import tokenizers

    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
    return "".join(piece for piece, _ in split.pre_tokenize_str(text))


@functools.cache
def classes(engine: str) -> np.ndarray:
    """Class of each code point; engines differ by their Unicode version."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", BLANK)):
        table[np.frombuffer(_members(pattern, text, engine).encode("utf-32-le"), dtype=np.uint32)] = kind
    table[ord(" ")] = SPACE
    return table


def _step(state: int, kind: int, gap: bool) -> tuple[int, int]:
    """(next state, pieces begun) on a character; gap: white space or the end follows."""
    blank = kind in (SPACE, BLANK)
    if state == JOINED and not blank:  # a space has begun the piece
        return {LETTER: LETTERS, NUMBER: NUMBERS}.get(kind, OTHERS), 0
    if state == LAST_TWO:
        return LAST_ONE, 0
    if state == LAST_ONE:
        return START, 0
    if (state, kind) in ((LETTERS, LETTER), (NUMBERS, NUMBER)) or state == OTHERS and kind in (OTHER, SHORT, LONG):
        return state, 0
    if state == BLANKS and blank and gap:
        return BLANKS, 0
    if blank:  # the last blank of a run begins a piece of its own, or joins what follows if it is a space
        return (BLANKS if gap else JOINED if kind == SPACE else START), 1
    return {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS, SHORT: LAST_ONE, LONG: LAST_TWO}[kind], 1


@functools.cache
def machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and begun pieces by symbol * 8 + state; symbol = kind * 4 + gap * 2 + first of its text."""
    nxt, begun = np.zeros(224, np.uint8), np.zeros(224, bool)
    for kind in range(7):
        for gap in (0, 1):
            for first in (0, 1):
                for state in range(8):
                    at = (kind * 4 + gap * 2 + first) * 8 + state
                    nxt[at], begun[at] = _step(START if first else state, kind, bool(gap))
    return nxt, begun


def _map(nxt: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Exit state by entry state (rows) of each chunk (columns)."""
    maps = np.repeat(np.arange(8, dtype=np.uint8)[:, None], columns.shape[1], axis=1)
    for column in columns:
        maps = nxt.take(column + maps, mode="clip")
    return maps


def scan(symbols: np.ndarray, entry: int) -> tuple[np.ndarray, int]:
    """Which symbols begin a piece, and the state after the last."""
    nxt, begun = machine()
    n = len(symbols)
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, dtype=np.uint16)
    padded[:n] = symbols
    padded *= 8
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    # a chunk's last characters mostly fix its exit state; only where they don't is the whole chunk run
    maps = _map(nxt, columns[-TAIL:])
    unsure = np.flatnonzero((maps != maps[0]).any(axis=0))
    if len(unsure):
        maps[:, unsure] = _map(nxt, columns[:, unsure])
    step = 1
    while step < chunks:  # after the pass of width step, a map covers 2 * step chunks
        later = np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.int64), axis=0)
        maps = np.concatenate((maps[:, :step], later), axis=1)
        step *= 2
    state = np.empty(chunks, dtype=np.uint8)
    state[0], state[1:] = entry, maps[entry, :-1]
    out = np.empty((CHUNK, chunks), dtype=bool)
    after = np.empty((CHUNK, chunks), dtype=np.uint8)
    for j, column in enumerate(columns):
        at = column + state
        begun.take(at, out=out[j], mode="clip")
        state = nxt.take(at, out=after[j], mode="clip")
    last = n - 1
    return out.T.reshape(-1)[:n], int(after[last % CHUNK, last // CHUNK])


def piece_starts(body: np.ndarray, off: np.ndarray, engine: str) -> np.ndarray:
    """Byte position of each piece's start in texts that lie end to end (UTF-8, valid)."""
    table = classes(engine)
    firsts = off[:-1][np.diff(off) > 0]
    found, state, at, n = [], START, 0, len(body)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n and body[end] & 0xC0 == 0x80:
            end -= 1
        look = min(n, end + 4)
        while look < n and body[look] & 0xC0 == 0x80:
            look += 1
        part = body[at:look]
        place = np.flatnonzero((part & 0xC0) != 0x80)
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        mark = np.zeros(len(part), dtype=bool)
        mark[firsts[np.searchsorted(firsts, at) : np.searchsorted(firsts, look)] - at] = True
        first = mark[place]
        kind = table[points]
        ends = np.ones(len(points), dtype=bool)
        ends[:-1] = first[1:]
        gap = ends.copy()
        gap[:-1] |= (kind[1:] == SPACE) | (kind[1:] == BLANK)
        if look < n and mark.size and not np.any(firsts == look):
            gap[-1] = False  # lies past the block, not used
        for i in np.flatnonzero(points == 39).tolist():
            if not ends[i]:
                a = chr(points[i + 1])
                if a in "stmd":
                    kind[i] = SHORT
                elif i + 2 < len(points) and not ends[i + 1] and a + chr(points[i + 2]) in ("re", "ve", "ll"):
                    kind[i] = LONG
        m = int(np.searchsorted(place, end - at))
        begins, state = scan((kind[:m].astype(np.uint16) * 4 + gap[:m] * 2 + first[:m]).astype(np.uint16), state)
        found.append(place[:m][begins] + at)
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int64)
