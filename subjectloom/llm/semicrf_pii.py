"""Personal data by a semi-Markov conditional random field.

Sarawagi and Cohen, "Semi-Markov conditional random fields for information
extraction" (2004).  Segments of up to ``LONGEST`` tokens are scored as wholes
(shape, digits, entropy, check sums, left context), and dynamic programming picks
boundaries and types of a text jointly.  The weights are fitted here by gradient
ascent on the conditional likelihood of ``SENTENCES`` generated sentences (forward
and backward sums over all segmentations); nothing is read from the corpus.

Base spans (fixed patterns, see ``base_spans``) always stay: each is one token of
the sequence and a segment of its own.  The decoder adds spans beside them; where it
has no base kind to give, the kind is ``secret``.

Only tokens within ``REACH`` of a trigger are decoded: a token with a digit or an at-sign, or a word
that announces a secret.  An entity has a digit or an at-sign, or follows such a word and an
assignment, so what lies farther away can only be outside.  An entity has at most ``LONGEST`` tokens
(runs of letters, digits and underscores, and single signs): enough for identifiers of five
dashed groups, for IPv6 addresses and for most signed tokens; longer ones are found in parts.  Time is
linear in the text; features are made for BLOCK tokens at a time and dropped, and a token keeps some
thirty bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, clean_text, small_batches

#: Kinds in listed order; ``secret`` is the model's own.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)
LONGEST, REACH, SENTENCES = 16, 8, 560
#: An entity of more tokens than these has no white space (numbers in groups have up to seven).
SPACED = 7

_domain = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of digits always begins where a run of digits does, so the look-behind
# changes no result; it and the possessive runs keep long runs linear and their stack flat.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_digits = re.compile(r"[^0-9]+").sub
_tokens = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]").finditer
# What announces a secret, as part of a word; other words of context stand whole.
_SECRETS = r"passw|passphrase|secret|token|api_?key|access_?key|private_?key|signing_?key|credential|bearer"
_plain_trigger = re.compile(r"[0-9@]").search
_full_trigger = re.compile(rf"[0-9@]|(?i:{_SECRETS}|\b(?:pwd|key|auth))").search
# Parts of all words that announce a secret: a text without them has no other triggers than signs.
_CUES = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "pwd", "auth")


def trigger_of(text: str):
    """The search for triggers in (stretches of) a text: the plain one where no word announces a secret."""
    low = text.lower()
    return _full_trigger if any(c in low for c in _CUES) else _plain_trigger


_secret_word = re.compile(rf"(?i:{_SECRETS})|^(?i:pwd|auth|key|apikey|authorization)$").search


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the four fixed patterns, by start and kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _local:
            start -= 1
        found = _domain(text, at) if start < at else None
        if found:
            out.append((start, found.end(), 0))
            done = found.end()
        at = text.find("@", max(at + 1, done))
        if not found:
            done = max(done, start)
    for m in _ip(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _card(text):
        if m.end() - m.start() >= 12:
            digits = _digits("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _phone(text):
            if 9 <= len(_digits("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# ---------------------------------------------------------------- the model

class Tokens(NamedTuple):
    """Starts, ends and base kinds (-1: none) of tokens, as arrays."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray


def tokenise(text: str, base: Iterable[tuple[int, int, int]], lo: int, hi: int) -> Tokens:
    """Tokens of a stretch; overlapping base spans are merged into one.  ``base``: sorted,
    those that end before the stretch may be left out."""
    start, end, kinds = array("q"), array("q"), array("b")

    def plain(a: int, b: int) -> None:
        for m in _tokens(text, a, b):
            start.append(m.start())
            end.append(m.end())
            kinds.append(-1)

    at = lo
    for s, e, kind in base:
        if s >= hi:
            break
        if e <= lo:
            continue
        if s < at and kinds and kinds[-1] >= 0:
            if e > end[-1]:
                end[-1] = at = e
            continue
        plain(at, s)
        start.append(s)
        end.append(e)
        kinds.append(kind)
        at = e
    plain(at, hi)
    return Tokens(np.array(start, np.int64), np.array(end, np.int64), np.array(kinds, np.int8))


_CONTEXT = {"phone": ("tel", "phone", "call", "fax", "mobile", "mob", "telefon", "tél", "ring", "dial", "hotline"), "email": ("mail", "email", "contact"), "ip": ("ip", "host", "server", "address", "ipv6", "addr"), "card": ("card", "visa", "payment", "iban", "ssn", "account", "konto")}
# Beginnings of tokens that services issue.
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat", "sk_live_", "sk_test_", "rk_live_", "AKIA", "ASIA", "AIza", "xoxb", "xoxp", "eyJ", "npm_", "pypi", "hf_", "SG")
FEATURES = ("bias", "tokens", "len<8", "len<16", "len<28", "len>=28", "digits", "hexadecimal", "mixed", "entropy", "one_word", "quoted", "spaces", "at_sign", "dots", "dashes", "local_phone", "luhn", "no_digit", "word", "three_classes", "hash_length", "ctx_secret", "ctx_phone", "ctx_email", "ctx_ip", "ctx_card", "assigned", "named", "named_quoted", "named_digit", "prefix", "whole", "grouped", "grouped_phone", "grouped_zero", "ssn", "iban", "uuid", "ipv6", "hash_secret", "date")

_WORDS = {w: [i for i, k in enumerate(("phone", "email", "ip", "card"), 1) if w in _CONTEXT[k]] for words in _CONTEXT.values() for w in words}
_local_phone = re.compile(r"\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}").fullmatch
_grouped = re.compile(r"\(?[0-9]{2,5}\)?(?: ?[/.-] ?| )[0-9]{2,8}(?:[ .-][0-9]{2,6}){0,4}").fullmatch
_ssn = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}").fullmatch
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").fullmatch
_uuid = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}").fullmatch
_ipv6 = re.compile(r"(?=.*[0-9a-fA-F]{3}|.*::)[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){2,7}").fullmatch
_date = re.compile(r"[12][0-9]{3}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][12][0-9]{3}|97[89][- ][0-9- ]{10,}").fullmatch
#: Signs that join the parts of one identifier.
_GLUE = frozenset("-+/~%")
_JOINS = _GLUE | frozenset(".:=")


def iban_checks(text: str) -> bool:
    """Whether an account number has the form and the check sum (modulo 97) of an IBAN."""
    if not _iban(text):
        return False
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def glued_left(text: str, start: int) -> bool:
    """Whether a sign joins what starts here to what stands before it."""
    before = text[start - 1] if start else " "
    return before in _GLUE or (before == "." and start > 1 and text[start - 2].isalnum())


def glued_right(text: str, end: int) -> bool:
    """Whether a sign joins what ends here to what follows."""
    return text[end : end + 1] in _JOINS and text[end + 1 : end + 2].isalnum()


#: Tokens whose segments are scored together, and characters that are counted together.
BLOCK, CHARS = 1024, 1 << 18


def _counts(piece: str, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The characters of a piece, and how often each stands in each token and in the gap after it."""
    chars = sorted(set(piece))
    points, u = np.array([ord(c) for c in chars], np.uint32), len(chars)
    inside, gaps = np.zeros(len(starts) * u, np.int64), np.zeros(len(starts) * u, np.int64)
    for at in range(0, len(piece), CHARS):
        codes = np.searchsorted(points, np.frombuffer(piece[at : at + CHARS].encode("utf-32-le", "surrogatepass"), np.uint32))
        place = np.arange(at, at + len(codes))
        token = np.searchsorted(starts, place, "right") - 1
        own = place < ends[token]
        inside += np.bincount(token[own] * u + codes[own], minlength=len(inside))
        gaps += np.bincount(token[~own] * u + codes[~own], minlength=len(gaps))
    return chars, inside.reshape(-1, u), gaps.reshape(-1, u)


def segments(text: str, tokens: Tokens, lo: int, hi: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length from 1 to LONGEST: the length, which of the tokens ``lo`` to ``hi``
    open a segment of that length that may be an entity, and the whole-segment
    features of those.

    An entity has a token with a digit or an at-sign or is assigned to the name of a secret; it begins and
    ends with letters or digits (or begins with a bracket) and has no base token and no line break.
    Everything about a segment is a sum over its tokens and gaps, so all segments of a
    length are done at once."""
    start, end, kind = tokens
    right = min(len(start), hi + LONGEST - 1)
    m, k, origin = hi - lo, right - lo, int(start[lo])
    piece = text[origin : int(end[right - 1])]
    chars, inside, gaps = _counts(piece, start[lo:right] - origin, end[lo:right] - origin)
    column = {c: i for i, c in enumerate(chars)}
    mask = lambda test: np.array([bool(test(c)) for c in chars], np.int64)
    alnum, isdigit, alpha = mask(str.isalnum), mask(str.isdigit), mask(str.isalpha)
    hexes, ascii_digit = mask(lambda c: c in "0123456789abcdefABCDEF"), mask(lambda c: c in "0123456789")
    trigger = inside @ mask(lambda c: c in "0123456789@") > 0
    free = kind[lo:right] < 0
    broken = gaps[:, column["\n"]] > 0 if "\n" in column else np.zeros(k, bool)
    # What stands to the left of each token: context words, and a sign that assigns a value.
    first = max(0, lo - 4)
    words = [text[a:b] if b - a <= 40 else "" for a, b in zip(start[first : lo + m].tolist(), end[first : lo + m].tolist(), strict=True)]
    said = np.zeros((len(words) + 4, 5), bool)
    for i, w in enumerate(words):
        if found := _WORDS.get(w.lower()):
            said[i + 4, found] = True
        if len(w) > 2 and _secret_word(w):
            said[i + 4, 0] = True
    skip = lo - first
    context = said[skip : skip + m] | said[skip + 1 : skip + 1 + m] | said[skip + 2 : skip + 2 + m] | said[skip + 3 : skip + 3 + m]
    assigned = np.array([i + skip > 0 and words[i + skip - 1] in ("=", ":", '"', "'", "`") for i in range(m)], bool)
    named = assigned & context[:, 0]
    firsts = [text[a] for a in start[lo:right].tolist()]
    closes = np.array([c.isalnum() or c == "_" for c in firsts], bool)
    zero = np.array([c in "0(" for c in firsts[:m]], bool)
    opens = closes[:m] | np.array([c == "(" for c in firsts[:m]], bool)
    issued = np.array([text.startswith(PREFIXES, a) for a in start[lo:hi].tolist()], bool)
    tied_left = np.array([glued_left(text, a) for a in start[lo:hi].tolist()], bool)
    tied_right = np.array([glued_right(text, b) for b in end[lo:right].tolist()], bool)
    uppers, lowers = mask(lambda x: x.isalpha() and x.isupper()), mask(lambda x: x.isalpha() and x.islower())
    quote = lambda at: text[at] if 0 <= at < len(text) and text[at] in "\"'`" else ""
    opening = np.array([quote(a - 1) for a in start[lo:hi].tolist()], dtype="U1")
    closing = np.array([quote(b) for b in end[lo:right].tolist()], dtype="U1")
    # Luhn sums of any run of digits: running sums with even, and with odd, places doubled.
    digits = np.array([int(c) for c in _digits("", piece)] if len(piece) <= CHARS else [], np.int64)
    doubled = 2 * digits - 9 * (digits > 4)
    even = np.arange(len(digits)) % 2 == 0
    sums = [np.concatenate([[0], np.cumsum(np.where(even == x, digits, doubled))]) for x in (True, False)]
    before = np.concatenate([[0], np.cumsum(inside @ ascii_digit)])
    total = np.zeros((m, len(chars)), np.int64)
    ok, seen, spaced = np.ones(m, bool), np.zeros(m, bool), np.zeros(m, bool)
    blank = gaps @ mask(str.isspace) > 0
    for length in range(1, LONGEST + 1):
        last = np.arange(m) + length - 1
        there = last < k
        last = np.minimum(last, k - 1)
        if length > 1:
            ok &= ~broken[np.minimum(last - 1, k - 1)]
            total += gaps[np.maximum(last - 1, 0)]
            spaced |= blank[np.maximum(last - 1, 0)]
            if length > SPACED:
                ok &= ~spaced
        ok &= there & free[last]
        if not ok.any():
            break
        total += inside[last]
        seen |= trigger[last]
        rows = np.flatnonzero(ok & (seen | named) & opens & closes[last])
        if not len(rows):
            continue
        c, j = total[rows], last[rows]
        n = (end[lo + j] - start[lo + rows]).astype(float)
        a, d = c @ alnum, c @ isdigit
        share = d / np.maximum(a, 1)
        logs = np.log2(c, out=np.zeros(c.shape), where=c > 0)
        entropy = np.log2(n) - (c * logs).sum(axis=1) / n
        of = lambda x, c=c: c[:, column[x]] if x in column else np.zeros(len(c), np.int64)
        f = np.zeros((len(rows), len(FEATURES)))
        f[:, 0] = 1.0
        f[:, 1] = (length - 1) / LONGEST
        f[:, 2], f[:, 3], f[:, 4], f[:, 5] = n < 8, (n >= 8) & (n < 16), (n >= 16) & (n < 28), n >= 28
        f[:, 6] = share
        f[:, 7] = (c @ hexes == a) & (d > 0) & (d < np.maximum(a, 1))
        f[:, 8] = (share > 0.1) & (share < 0.9) & (c @ alpha > 0)
        f[:, 9] = entropy / 5
        f[:, 10] = length == 1
        f[:, 11] = (opening[rows] != "") & (opening[rows] == closing[j])
        f[:, 12], f[:, 13], f[:, 14], f[:, 15] = of(" ") / n, of("@") > 0, of(".") / n, of("-") / n
        numbers = c @ ascii_digit
        part = lambda r, j=j, rows=rows: text[int(start[lo + rows[r]]) : int(end[lo + j[r]])]
        for r in np.flatnonzero((numbers == 10) & (n >= 12) & (n <= 14)).tolist():
            f[r, 16] = bool(_local_phone(part(r)))
        for r in np.flatnonzero((numbers >= 12) & (numbers <= 19) & (numbers == a)).tolist():
            p, q = int(before[rows[r]]), int(before[j[r] + 1])
            f[r, 17] = (sums[(q - 1) % 2][q] - sums[(q - 1) % 2][p]) % 10 == 0 if len(digits) else luhn(_digits("", text[int(start[lo + rows[r]]) : int(end[lo + j[r]])]))
        upper, lower = c @ uppers, c @ lowers
        f[:, 18], f[:, 19], f[:, 20] = d == 0, (lower == n) & (length == 1), (upper > 0) & (lower > 0) & (d > 0) & (of(" ") == 0)
        f[:, 21] = (f[:, 7] > 0) & ((n == 32) | (n == 40) | (n == 64)) & (length == 1)
        f[:, 22:27] = context[rows]
        f[:, 27], f[:, 28] = assigned[rows], named[rows] & (of(" ") == 0)
        f[:, 29], f[:, 30] = (f[:, 28] > 0) & (f[:, 11] > 0), (f[:, 28] > 0) & (d > 0)
        f[:, 31] = issued[rows] & (n >= 12) & (of(" ") == 0)
        f[:, 32] = ~(tied_left[rows] | tied_right[j])
        signs = of("-") + of(".") + of("/")
        parted = signs >= 2  # a date and a number of three dashed parts have two of these
        # Bare groups of digits say nothing without such a sign, a word of context, or a leading zero.
        telling = (signs > 0) | (f[:, 23] > 0) | zero[rows]
        for r in np.flatnonzero((numbers >= 7) & (numbers <= 12) & (numbers == a) & (n <= 20) & (n > numbers) & telling).tolist():
            said_ = part(r)
            if parted[r]:
                f[r, 41] = bool(_date(said_))
                f[r, 36] = bool(_ssn(said_))
            f[r, 33] = bool(_grouped(said_)) and not f[r, 41]
        f[:, 34] = (f[:, 33] > 0) & (f[:, 23] > 0)
        for r in np.flatnonzero(f[:, 33] > 0).tolist():
            f[r, 35] = part(r).lstrip("(")[0] == "0"
        for r in np.flatnonzero((numbers == 13) & (numbers == a) & (n >= 16)).tolist():
            f[r, 41] = bool(_date(part(r)))
        for r in np.flatnonzero((n >= 15) & (n <= 42) & (upper >= 2) & (upper + d == a) & (d >= 10)).tolist():
            f[r, 37] = iban_checks(part(r))
        for r in np.flatnonzero((n == 36) & (of("-") == 4)).tolist():
            f[r, 38] = bool(_uuid(part(r)))
        for r in np.flatnonzero((of(":") >= 2) & (n <= 39) & (c @ hexes == a)).tolist():
            f[r, 39] = bool(_ipv6(part(r)))
        f[:, 40] = (f[:, 21] > 0) & (f[:, 22] > 0)
        yield length, rows, f


def decode(text: str, tokens: Tokens, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The best segmentation's entities: (start, end, kind index), base tokens left out.

    One pass from left to right; a token keeps a score and two small numbers."""
    n = len(tokens.start)
    best = array("d", [-math.inf]) * (n + 1)
    best[0] = 0.0
    size, label, kind_of = bytearray(n + 1), bytearray(n + 1), tokens.kind.tolist()
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        # Label 0 is outside (one token, score 0); a base token is its own kind.
        score = np.full((LONGEST, hi - lo), -np.inf)
        name = np.zeros((LONGEST, hi - lo), np.int64)
        score[0] = 0.0
        name[0] = tokens.kind[lo:hi] + 1
        for length, rows, f in segments(text, tokens, lo, hi):
            s = f @ weights
            kind, top = s.argmax(axis=1), s.max(axis=1)
            # Tokens outside score 0, so a segment that does not score more is never needed.
            win = top > np.maximum(score[length - 1, rows], 0.0)
            score[length - 1, rows[win]] = top[win]
            name[length - 1, rows[win]] = kind[win] + 1
        lengths, places = np.nonzero(score > 0)
        order = np.argsort(places, kind="stable")
        more: dict[int, list[tuple[int, float, int]]] = {}
        for length, place in zip(lengths[order].tolist(), places[order].tolist(), strict=True):
            more.setdefault(lo + place, []).append((length + 1, float(score[length, place]), int(name[length, place])))
        first = name[0].tolist()
        for i in range(lo, hi):
            so_far = best[i]
            if so_far > best[i + 1]:
                best[i + 1] = so_far
                size[i + 1], label[i + 1] = 1, first[i - lo] if kind_of[i] >= 0 else 0
            for length, way, kind in more.get(i, ()):
                if so_far + way > best[i + length]:
                    best[i + length] = so_far + way
                    size[i + length], label[i + length] = length, kind
    out, at = [], n
    while at > 0:
        i = at - size[at]
        if label[at] and tokens.kind[i] < 0:
            out.append((int(tokens.start[i]), int(tokens.end[at - 1]), label[at] - 1))
        at = i
    return out[::-1]


def _sample(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """A generated sentence and its entities."""
    pick = lambda *options: str(options[rng.integers(0, len(options))])
    of = lambda chars, n: "".join(chars[k] for k in rng.integers(0, len(chars), n))
    lower, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    many = lower + lower.upper() + digits
    word = lambda: of("aeiounrstlhdmpc", rng.integers(2, 9))
    number = lambda n: of(digits, n)
    mixed = lambda n: of(many, n - 2) + of(digits, 1) + of(lower, 1)
    name = lambda: pick("token", "api_key", "secret", "password", "key", "PASSWORD", "passwd", "pwd", "auth_token", "client_secret", "aws_access_key_id", "DB_PASSWORD", "accessToken", "private_key", "apikey", word() + "_token", word().upper() + "_SECRET")
    sign = lambda: pick("=", " = ", ": ", ":", '="', ' = "', ": '", ' "')
    close = lambda opened: next((q for q in "\"'" if q in opened), "")

    def assigned(value: str) -> str:
        opened = sign()
        return f"{name()}{opened}<4|{value}>{close(opened)}"

    def phone() -> str:
        return pick(f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"{number(3)}.{number(3)}.{number(4)}", f"0{number(2)}/{number(7)}", f"0{number(2)} {number(4)} {number(4)}", f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{number(3)}-{number(6)}", f"0{number(4)} {number(6)}")

    def iban() -> str:
        body = f"DE00{number(18)}" if rng.random() < 0.5 else f"{pick('GB', 'FR', 'ES', 'NL')}00{of(digits + lower.upper(), 4)}{number(int(rng.integers(10, 15)))}"
        left = 98 - int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97
        plain = f"{body[:2]}{left:02d}{body[4:]}"
        return " ".join(plain[k : k + 4] for k in range(0, len(plain), 4)) if rng.random() < 0.4 else plain

    uuid = lambda: "-".join(of(hexes, n) for n in (8, 4, 4, 4, 12))
    clean = lambda: of(many, 1) + of(many + "-_", int(rng.integers(10, 40))) + of(many, 1)
    made = (
        # Secrets, announced or of a known form.
        lambda: assigned(pick(of(hexes, 40), of(hexes, 32), mixed(int(rng.integers(20, 41))))),
        lambda: assigned(pick(of(hexes, 40), of(hexes, 32), mixed(int(rng.integers(20, 41))))),
        lambda: assigned(pick(word() + number(int(rng.integers(1, 5))), mixed(int(rng.integers(8, 16))), of(many, 4) + "-" + mixed(6) + "-" + mixed(5))),
        lambda: f'{name()}{pick("=", " = ", ": ")}"<4|{of(lower, int(rng.integers(8, 24)))}>"',
        lambda: f"{word()} <4|{pick('ghp_', 'gho_', 'sk_live_', 'AKIA', 'AIza', 'npm_', 'hf_')}{mixed(int(rng.integers(16, 36)))}>",
        lambda: f"{pick('Bearer ', 'bearer ', 'jwt ', 'Authorization: Bearer ', word() + ' ')}<4|eyJ{mixed(18)}.eyJ{clean()}.{clean()}>",
        lambda: assigned(mixed(12) + "/" + mixed(10) + "+" + mixed(8)),
        lambda: f"{pick('token', 'secret', 'key')}{pick('=', ': ', ' = ')}<4|{uuid()}>",
        lambda: f"{pick('iban', 'account', 'konto', 'IBAN:', word())} <4|{iban()}>",
        lambda: f"{pick('ssn', 'SSN:', 'social security number', word())} <4|{number(3)}-{number(2)}-{number(4)}>",
        # Phones with a word beside them or in a full local form, addresses.
        lambda: f"{pick('call', 'tel', 'phone', 'fax', 'tel.', 'Phone:', 'mobile', 'Tel:', 'ring')} <3|{phone()}>",
        lambda: f"{pick('call', 'tel', 'phone', word(), word())} <3|{pick(f'({number(3)}) {number(3)}-{number(4)}', f'{number(3)}-{number(3)}-{number(4)}', f'{number(3)} {number(3)} {number(4)}', f'0{number(2)} {number(4)} {number(4)}')}>",
        lambda: f"{pick('host', 'ipv6', 'address', word())} <1|{pick(f'2001:db8:{of(hexes, 4)}:{of(hexes, 4)}::{of(hexes, 2)}', ':'.join(of(hexes, 4) for _ in range(8)), f'fe80::{of(hexes, 4)}:{of(hexes, 4)}:{of(hexes, 4)}:{of(hexes, 4)}')}>",
        # What only looks like one.
        lambda: f"{pick('host', 'server', word(), 'at')} {number(2)}:{number(2)}:{number(2)}",
        lambda: f"{pick('key', 'token', 'version', 'chapter', word())} {number(int(rng.integers(1, 7)))}",
        lambda: f"{pick('', 'on ', 'since ')}{pick('20', '19')}{number(2)}-0{number(1)}-1{number(1)} {number(1)}.{number(1)}.{number(2)}",
        lambda: f"{number(int(rng.integers(5, 12)))} {word()}{number(2)}",
        lambda: f"{number(2)} @ {word()} ${number(3)}.{number(2)}",
        lambda: f'"{word()}{number(1)}" = {number(3)}',
        lambda: f"{of(hexes, 8)} {number(5)}-{number(4)}",
        lambda: f"{pick('commit', 'sha1', 'md5', 'checksum', 'digest', 'hash', word())} {pick('', ': ', '= ')}{pick(of(hexes, 40), of(hexes, 32), of(hexes, 64), of(hexes, 7))}",
        lambda: f"{pick('id', 'uuid', 'request', word())}{pick(' ', ': ', '=')}{uuid()}",
        lambda: f"{pick('isbn', 'ISBN', 'ISBN:')} 97{pick('8', '9')}-{number(1)}-{number(3)}-{number(5)}-{number(1)}",
        lambda: f"{pick('version', 'v', 'release', 'python')} {number(1)}.{number(2)}.{number(1)}{pick('', 'rc1', '-beta2', '.post1')}",
        lambda: f"{pick('password', 'token', 'secret', 'key', 'auth')}{pick(': ', ' = ', ' is ', ' ')}{pick(word(), 'required', 'None', 'true', 'optional', 'must contain ' + number(1) + ' digits')}",
        lambda: f"{pick('the password', 'this token', 'a secret', 'the key')} {word()} {word()} {number(int(rng.integers(1, 4)))}",
        lambda: f"{pick('pages', 'lines', 'years', word())} {number(int(rng.integers(2, 5)))}-{number(int(rng.integers(2, 5)))}",
        lambda: f"{pick('order', 'invoice', 'no.', 'ref', word())} {pick(number(8), number(10), 'A' + number(6), number(4) + '/' + number(3))}",
        lambda: f"{pick('phone', 'call', 'tel')} {word()} {number(int(rng.integers(1, 4)))}",
        lambda: f"{word()} {pick(number(3) + ' ' + number(3), number(1) + ',' + number(3) + ',' + number(3), number(2) + ' ' + number(2) + ' ' + number(2))} {word()}",
        lambda: f"{word()} {word()}",
    )
    middle = made[rng.integers(0, len(made))]()
    raw = " ".join([*(word() for _ in range(rng.integers(1, 5))), middle + pick("", "", "", ".", ","), *(word() for _ in range(rng.integers(0, 5)))])
    text, gold, at = "", [], 0
    for m in re.finditer(r"<([0-9])\|([^>]*)>", raw):
        text += raw[at : m.start()]
        gold.append((len(text), len(text) + len(m[2]), int(m[1])))
        text += m[2]
        at = m.end()
    return text + raw[at:], gold


@lru_cache(maxsize=1)
def fit(seed: int = 7, rounds: int = 100, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights (features x kinds) that maximise the mean conditional likelihood of the generated
    sentences, less a ridge, by Adam on forward-backward expectations of all sentences at once."""
    rng = np.random.default_rng(seed)
    places, matrix, gold, lengths = [], [], [], []
    for number in range(SENTENCES):
        text, spans = _sample(rng)
        tokens = tokenise(text, base_spans(text), 0, len(text))
        n, want = len(tokens.start), {(s, e): k for s, e, k in spans}
        lengths.append(n)
        for length, rows, f in segments(text, tokens, 0, n):
            places.append(np.stack([np.full(len(rows), number), rows, np.full(len(rows), length)], 1))
            matrix.append(f)
            gold += [want.get((int(tokens.start[i]), int(tokens.end[i + length - 1])), -1) for i in rows.tolist()]
    (number, begin, length), x, gold, n = np.concatenate(places).T, np.concatenate(matrix), np.array(gold), np.array(lengths)
    right = np.zeros((len(gold), len(KINDS)))
    right[np.flatnonzero(gold >= 0), gold[gold >= 0]] = 1.0
    # Label 0 is outside, one token, score 0; a base token is its own kind, with score 0 as well.
    alone = np.full((SENTENCES, n.max(), LONGEST + 1), -np.inf)
    for k, size in enumerate(lengths):
        alone[k, :size, 1] = 0.0
    weights, mean, square = np.zeros((x.shape[1], len(KINDS))), 0.0, 0.0
    weights[0] = -2.0
    every = np.arange(SENTENCES)
    for step in range(1, rounds + 1):
        scores = x @ weights
        whole = alone.copy()
        whole[number, begin, length] = np.logaddexp(whole[number, begin, length], np.logaddexp.reduce(scores, axis=1))
        alpha, beta = np.full((SENTENCES, n.max() + 1), -np.inf), np.full((SENTENCES, n.max() + 1 + LONGEST), -np.inf)
        alpha[:, 0], beta[every, n] = 0.0, 0.0
        for j in range(1, n.max() + 1):
            back = np.arange(1, min(LONGEST, j) + 1)
            alpha[:, j] = np.logaddexp.reduce(alpha[:, j - back] + whole[:, j - back, back], axis=1)
        for i in range(n.max() - 1, -1, -1):
            own = np.logaddexp.reduce(beta[:, i + 1 : i + 1 + LONGEST] + whole[:, i, 1:], axis=1)
            beta[:, i] = np.where(i < n, own, beta[:, i])
        outer = alpha[number, begin] + beta[number, begin + length] - alpha[every, n][number]
        slope = x.T @ (right - np.exp(outer[:, None] + scores)) / SENTENCES - ridge * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        weights = weights + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return weights


def spans_of(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans (base and decoded) by start and kind."""
    trigger = trigger_of(text)
    if not trigger(text):
        return [], []
    base = base_spans(text)
    found = list(base)
    # Stretches of REACH tokens around triggers; between them all is outside.
    passed = 0
    for lo, hi in _stretches(text, trigger):
        while passed < len(base) and base[passed][1] <= lo:
            passed += 1
        tokens = tokenise(text, islice(base, passed, None), lo, hi)
        if len(tokens.start):
            found.extend(decode(text, tokens, weights))
    return base, sorted(set(found), key=lambda s: (s[0], s[2], s[1]))


def _stretches(text: str, trigger) -> Iterator[tuple[int, int]]:
    """Merged ranges of whole words around words that hold a trigger."""
    recent: list[int] = []
    lo = hi = -1
    left = 0
    for m in re.finditer(r"\S+", text):
        recent.append(m.start())
        if len(recent) > REACH + 1:
            recent.pop(0)
        if trigger(text, m.start(), m.end()):
            if lo < 0:
                lo = recent[0]
            left = REACH
        elif lo >= 0:
            left -= 1
        if lo >= 0:
            hi = m.end()
            if not left:
                yield lo, hi
                lo = -1
    if lo >= 0:
        yield lo, hi


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans by the first's."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


REPORT = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS[:4]], ("base_sha256", pa.string()), ("spans", pa.string()), ("n_spans", pa.int64())])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256`` and
    ``spans`` (kind:start:end, comma-joined, code points; ``n_spans`` of them) of every row.

    Defined results: null and empty texts have no spans (the digest of the empty
    string); repeated rows are treated alike; a null id is carried through.
    """
    weights = fit()
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    base, spans = spans_of(text.as_py(), weights)
                    n = Counter(k for _, _, k in base)
                    yield doc_id.as_py(), n[0], n[1], n[2], n[3], hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(spans)

        yield from bounded(rows(), REPORT, 5_000)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), clean_text(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind (``<EMAIL>``); null texts stay null."""
    small_batches(docs.sparkSession)
    weights, at = fit(), docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := v.as_py()) is None else redacted(t, spans_of(t, weights)[1]) for v in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op2_semicrf_pii(spark, sf_dir: str) -> DataFrame:
    """``find_pii`` over the whole of ``documents``."""
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
