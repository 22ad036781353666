"""Personal data: fixed patterns, and a linear-chain CRF over word-shape features.

Base spans come from four patterns with their checks. A conditional random field
with BIO labels adds spans that the patterns miss: phone numbers without `+`,
card numbers that are split differently, addresses without a dot, and secrets
(passwords, keys, tokens), a kind of its own. It is trained by gradient ascent on
a small labelled table, made in this module from sentences with places for
values, and decoded by Viterbi in numpy batches. Features are the shapes of a
word and its two neighbours on either side, and whether they are cue words. Added
spans never replace or overlap base ones.

Whole texts are decoded. The field is constrained, in training as in decoding: a
word without digit, `@` and `+` is outside, unless it is made of separators alone
and stands between two others. The best path is then the best paths of the
stretches between such words, so only those are decoded, with their neighbours as
context, and the result is that of the whole text. A long stretch is scored in
pieces; the Viterbi state is carried from one to the next.

Offsets are code points, end exclusive. Defined cases: null text is empty: no
spans. Rows repeating a document are searched one by one; an empty table gives no
rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in order, and their patterns. Secrets have none.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each lies around an `@`, so only those places are looked at."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > free and text[a - 1] in EMAIL_LOCAL:
            a -= 1
        if a < at and (m := EMAIL_DOMAIN.match(text, at + 1)):
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or "0") <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if 13 <= len(m[0]) <= 40:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


#: The labelled table: sentences in which `{kind}` is a value of that kind and `{x:rule}` one that is none.
SENTENCES = """
please write to {email} before noon
contact {email}, or visit the office
his address is {email}. thanks
mail {email} for more
send the file to {email} and {email} today
reply to {email} or call {phone} now
call {phone} now
call me on {phone}, then wait
ring {phone} after six
phone {phone} for a table
phone: {phone}
phone {phone}, {phone} or {phone}
tel {phone}, ask for the owner
tel. {phone} or come by
Tel: {phone}
telephone {phone} between nine and five
mobile {phone}
fax {phone} or {phone}.
reach me on {phone} at night
my number is {phone} and my card is {card}
numbers {phone} and {phone} were used
the {phone} line and the {phone} line
call {phone} or write to {email}
dial {phone} from abroad
telefon {phone} oder {email}
the server {ip} is down
ping {ip}, then {ip}.
host {ip} answered at once
from {ip} to the gate at {x:time}
card {card} was charged
card {card}, expires soon
paid with {card} last week
visa {card} on file
the card no. {card} was used on {x:date}
credit card: {card}
{ip} {card}
{card}, {phone}
{ip}, {card} or {phone}
password={secret} in the file
password: {secret}
the password is {secret} for now
my password {secret} is old
pwd={secret} user=ann
passwd = {secret}
token = "{secret}" was found
token: {secret}
api_key={secret} and more
api key {secret} must go
secret={secret}
secret = '{secret}' stands in the log
key="{secret}"
access key {secret}
bearer {secret}
the token {secret} has leaked
in {x:year} we sold {x:count} units for {x:small} each
the order {x:serial} has {x:small} items
the order {x:long} has {x:small} items
order {x:long} of {x:date} {x:time} is late
version {x:version} came after version {x:version} in may
room {x:small}, floor {x:small}, house {x:small}
on {x:date} at {x:time} we met
from {x:date} {x:time} to {x:date} {x:time} it rained
log {x:date} {x:time} job {x:small} ended
pages {x:range} and {x:range} of part {x:small}
he paid {x:money} in {x:year}
section {x:version} covers {x:small} cases
about {x:count} people and {x:small} dogs
the total is {x:long} in the list
chapter {x:small}, verses {x:range}, line {x:small}
it rose by {x:money}% to {x:small}
the c++ and a+b notes
ratio {x:part}
part {x:part} is sold out
model {x:serial} and model {x:part}
isbn {x:isbn}
id {x:hex} and id {x:hex}
the hash {x:hex} is known
commit {x:hex} of {x:date}
checksum {x:hex}
file {x:hex} was read
license version {x:version} applies
under cc by-nc {x:version} terms
see http://www.example.org/page?id={x:small} for more
meet at {x:small} or at {x:small}, room {x:small}
the years {x:years} were dry
sizes {x:small} x {x:small} x {x:small} and {x:range}
invoice {x:long} of {x:year} for {x:money}
invoice {x:part} for {x:money}
the numbers {x:small} {x:small} {x:small} {x:small} came up
add {x:count} and {x:count} to {x:count}
the score was {x:range} and then {x:range}
batch {x:serial} of {x:date}
the plain words here have no number at all
nothing to see in this long and simple line of words
to be or not to be that is the question
{x:small}. the first point is this
{x:small}) the second point, see page {x:small}
""".strip().split("\n")
ROUNDS = 6

#: Fixed values: `#` is a digit, `N` a digit from 1 to 9.
PHONE_FORMS = ("(N##) ###-####", "(N##)###-####", "N##-###-####", "N##.###.####", "N## ### ####", "0N## #### ###", "0N# #### ####", "00N# ## ######", "0N## ######", "0N##/######", "(0N#) ###-####", "(0N#) - ######", "0N-## ## ## ##", "+N (N##) ###-####", "+N# N# #### ####", "+N-N##-###-####")
CARD_JOINTS = (" ", "-", ".", "  ", " - ", "/", "")
SECRET_ALPHABETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
NAMES = ("ann", "bob", "carla", "j_r.smith", "info", "x.y", "sales+news")
HOSTS = ("mail.example.org", "shop.example.com", "uni.example.edu", "localhost", "intranet", "mailhost")


def filled(form: str, draw: random.Random) -> str:
    return "".join(str(draw.randrange(10)) if c == "#" else str(draw.randrange(1, 10)) if c == "N" else c for c in form)


def _card(draw: random.Random) -> str:
    body = str(draw.randrange(3, 7)) + filled("#" * draw.choice((12, 14, 14, 14)), draw)
    body += next(d for d in "0123456789" if luhn(body + d))
    return draw.choice(CARD_JOINTS).join(body[i : i + 4] for i in range(0, len(body), 4))


def _secret(draw: random.Random) -> str:
    letters = draw.choice(SECRET_ALPHABETS)
    while True:
        value = "".join(draw.choice(letters) for _ in range(draw.choice((10, 12, 16, 18, 24, 32, 40))))
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            return value


MADE = {
    "email": lambda r: f"{r.choice(NAMES)}@{r.choice(HOSTS)}",
    "ip": lambda r: ".".join(str(r.randrange(256)) for _ in range(4)) + r.choice(("", "", f":{r.randrange(1, 65536)}")),
    "card": _card,
    "phone": lambda r: filled(r.choice(PHONE_FORMS), r),
    "secret": _secret,
    "x:year": lambda r: str(r.randrange(1900, 2030)),
    "x:years": lambda r: f"{r.randrange(1900, 1990)}-{r.randrange(1990, 2030)}",
    "x:date": lambda r: r.choice((f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1990, 2030)}", f"{r.randrange(1, 13)}/{r.randrange(1, 29)}/{r.randrange(1990, 2030)}")),
    "x:time": lambda r: f"{r.randrange(24):02}:{r.randrange(60):02}" + r.choice(("", f":{r.randrange(60):02}")),
    "x:small": lambda r: str(r.randrange(1, 1000)),
    "x:count": lambda r: r.choice((str(r.randrange(1000, 100_000)), f"{r.randrange(1, 1000)},{r.randrange(1000):03}")),
    "x:long": lambda r: str(r.randrange(10**6, 10**12)),
    "x:money": lambda r: f"{r.randrange(1, 5000):,}.{r.randrange(100):02}",
    "x:version": lambda r: ".".join(str(r.randrange(20)) for _ in range(r.choice((2, 3)))),
    "x:range": lambda r: f"{(a := r.randrange(1, 900))}-{a + r.randrange(1, 60)}",
    "x:serial": lambda r: filled(r.choice(("A##-B##", "N####", "X-####", "N###/##", "QN#####Z")), r),
    "x:part": lambda r: filled(r.choice(("N######-####", "N###-####", "N####-#####", "N##-####-#")), r),
    "x:isbn": lambda r: filled(r.choice(("97N-N-####-####-#", "N-###-#####-#")), r),
    "x:hex": lambda r: "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 12, 32, 40)))),
}
_PLACE = re.compile(r"\{([a-z:]+)\}")


def made(sentence: str, draw: random.Random, kinds: dict = MADE) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence with its places filled, and the spans of the values that are personal."""
    text, spans, at = "", [], 0
    for m in _PLACE.finditer(sentence):
        text += sentence[at : m.start()]
        value = kinds[m[1]](draw)
        if not m[1].startswith("x:"):
            spans.append((m[1], len(text), len(text) + len(value)))
        text += value
        at = m.end()
    return text + sentence[at:], spans


def labelled(rounds: int = ROUNDS, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The labelled table: (text, spans), each sentence `rounds` times with other values."""
    draw = random.Random(seed)
    return [made(s, draw) for _ in range(rounds) for s in SENTENCES]


LABELS = ("O", *(f"{b}-{k}" for k in ALL_KINDS for b in "BI"))
_MARKS = frozenset("0123456789@+")
_BARRED = -1e6
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SEPARATORS = frozenset("-./()")


def marked(word: str) -> bool:
    """Whether a word may be inside a span wherever it stands."""
    return not _MARKS.isdisjoint(word)


def barred(words: list[str]) -> np.ndarray:
    """Which words are outside: unmarked ones, but for separators between two marked ones."""
    on = np.array([marked(w) for w in words], bool)
    out = ~on
    for i in np.flatnonzero(out[1:-1]) + 1 if len(words) > 2 else ():
        out[i] = not (on[i - 1] and on[i + 1] and _SEPARATORS.issuperset(words[i]))
    return out


#: Words that tell what kind of value is near.
CUES = {
    "phone": "call phone ring tel telephone mobile cell fax dial reach telefon handy teléfono téléphone",
    "card": "card visa mastercard amex credit debit karte carte tarjeta",
    "email": "mail email write contact reply send",
    "ip": "server host ping ip router gateway",
    "secret": "password passwd pwd passwort contraseña token secret key api apikey bearer access",
    "other": "order invoice page pages ratio part model version section room floor chapter isbn id hash commit checksum file batch log line units house size sizes score years verses total about license item items article figure table serial code ref reference digest block build",
}
_CUE = {w: i for i, words in enumerate(CUES.values()) for w in words.split()}
_LETTERS = re.compile(r"[^\W\d_]+")

# Word shapes: a number that holds what the features need.
_FLAGS = (
    ("at", lambda w: "@" in w),
    ("plus", lambda w: "+" in w),
    ("plus_start", lambda w: w.startswith("+") and len(w) > 1),
    ("opens", lambda w: w.startswith("(")),
    ("closes", lambda w: ")" in w),
    ("dash", lambda w: "-" in w.strip("-")),
    ("colon", lambda w: ":" in w.strip(":")),
    ("slash", lambda w: "/" in w),
    ("percent", lambda w: "%" in w),
    ("comma", lambda w: "," in w.strip(",")),
    ("letters", lambda w: any(c.isalpha() for c in w)),
    ("ends", lambda w: w[-1:] in ".,;:!?"),
    ("equals", lambda w: "=" in w),
    ("quoted", lambda w: w[:1] in "\"'"),
    ("mixed", lambda w: any(not r.isdigit() and not r.isalpha() for r in _RUN.findall(w))),
    ("zero", lambda w: w.lstrip("(")[:1] == "0"),
    ("date", lambda w: bool(_DATE.search(w))),
    ("time", lambda w: bool(_TIME.search(w))),
    ("separator", lambda w: _SEPARATORS.issuperset(w)),
    ("numeric", lambda w: bool(_NUMERIC.fullmatch(w))),
    ("groups", lambda w: len(_GROUP.findall(w)) >= 3),
)
_RUN = re.compile(r"[A-Za-z0-9]{8,}")
_DATE = re.compile(r"(?<![0-9])(?:[12][0-9]{3}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[12][0-9]{3})(?![0-9])")
_TIME = re.compile(r"(?<![0-9:])[0-2]?[0-9]:[0-5][0-9]")
_NUMERIC = re.compile(r"[0-9.\-+()/]+[.,;:!?]?")
_GROUP = re.compile(r"[0-9]+")
_DIGITS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 16, 20)
_QUADS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")


def shape(word: str) -> tuple[int, ...]:
    """The features of a word: flags that hold, its digits (bucketed), its inner dots, whether it is a quad of numbers, its cue."""
    on = [i for i, (_, f) in enumerate(_FLAGS) if f(word)]
    digits = sum(c in "0123456789" for c in word)
    n = len(_FLAGS)
    on.append(n + sum(digits >= d for d in _DIGITS) - 1)
    n += len(_DIGITS)
    on.append(n + min(word.strip(".,;:!?").count("."), 4))
    n += 5
    if _QUADS.search(word):
        on.append(n)
    n += 1
    first = _LETTERS.search(word)
    if first and (cue := _CUE.get(first[0].lower())) is not None:
        on.append(n + cue)
    return tuple(on)


FEATURES = len(_FLAGS) + len(_DIGITS) + 5 + 1 + len(CUES)
_WINDOW = (-2, -1, 0, 1, 2)
_EDGE = FEATURES  # beyond either end of a text


def matrix_of(shapes: list[tuple[int, ...]]) -> np.ndarray:
    """(words, window * (FEATURES + 1)) feature matrix of one sequence."""
    n = len(shapes)
    own = np.zeros((n + 4, FEATURES + 1), np.float64)
    own[[0, 1, n + 2, n + 3], _EDGE] = 1
    for i, s in enumerate(shapes):
        own[i + 2, list(s)] = 1
    return np.concatenate([own[2 + d : 2 + d + n] for d in _WINDOW], 1)


def tagged(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], np.ndarray]:
    """The words of a text, and the label of each: of the span it overlaps, B where the span starts."""
    words, y = [], []
    for t in _TOKEN.finditer(text):
        words.append(t[0])
        kind = next(((k, a) for k, a, b in spans if a < t.end() and t.start() < b), None)
        y.append(0 if kind is None else LABELS.index(("B-" if t.start() <= kind[1] else "I-") + kind[0]))
    return words, np.array(y)


@dataclass
class Model:
    emit: np.ndarray  # (window * (FEATURES + 1), labels)
    move: np.ndarray  # (labels, labels)


def legal() -> np.ndarray:
    """Moves into I-x only from B-x or I-x."""
    ok = np.ones((len(LABELS), len(LABELS)), bool)
    for j, b in enumerate(LABELS):
        if b[0] == "I":
            ok[:, j] = [a[2:] == b[2:] for a in LABELS]
    return ok


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def sums(scores: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward log sums of a batch (sequences, words, labels), and the total of each; words beyond a sequence's size stay 0."""
    n, length, _ = scores.shape
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + move[0]
    for t in range(1, length):
        ahead[:, t] = scores[:, t] + _log_sum(ahead[:, t - 1, :, None] + move, 1)
    for t in range(length - 2, -1, -1):
        step = _log_sum(move + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        back[:, t] = np.where((t + 1 < sizes)[:, None], step, 0)
    return ahead, back, _log_sum(ahead[np.arange(n), sizes - 1], 1)


@lru_cache(maxsize=1)
def trained(rounds: int = 80, rate: float = 0.1, shrink: float = 0.05) -> Model:
    """The CRF of the labelled table: Adam on the penalised conditional log-likelihood, all sequences in one batch."""
    data = [tagged(text, spans) for text, spans in labelled()]
    sizes = np.array([len(y) for _, y in data])
    n, length, k = len(data), int(sizes.max()), len(LABELS)
    x = np.zeros((n, length, len(_WINDOW) * (FEATURES + 1)))
    gold, bar = np.zeros((n, length, k)), np.zeros((n, length, k))
    here = np.arange(length) < sizes[:, None]
    steps = np.zeros((k, k))
    for i, (words, y) in enumerate(data):
        x[i, : len(y)] = matrix_of([shape(w) for w in words])
        gold[i, np.arange(len(y)), y] = 1
        bar[i, : len(y)][barred(words), 1:] = _BARRED
        np.add.at(steps, (np.concatenate(([0], y[:-1])), y), 1)
    ok = legal()
    params = [np.zeros((x.shape[2], k)), np.zeros((k, k))]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, rounds + 1):
        emit, move = params[0], np.where(ok, params[1], _BARRED)
        scores = x @ emit + bar
        ahead, back, total = sums(scores, sizes, move)
        p = np.exp(ahead + back - total[:, None, None]) * here[:, :, None]
        pair = np.exp(ahead[:, :-1, :, None] + move + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * here[:, 1:, None, None]
        expected = pair.sum((0, 1))
        expected[0] += p[:, 0].sum(0)
        grads = [np.tensordot(x, gold - p, ((0, 1), (0, 1))) - shrink * emit, steps - expected - shrink * params[1]]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g**2
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return Model(params[0], np.where(ok, params[1], _BARRED))


def viterbi(score, length: int, sizes: np.ndarray, move: np.ndarray, piece: int) -> np.ndarray:
    """Best labels of a batch of sequences; before and after each stands an outside word.

    score(a, b) gives the scores (sequences, b - a, labels) of words a to b: they
    are asked for in pieces, and the state is carried from one to the next.
    """
    n, k = len(sizes), len(move)
    back = np.zeros((n, length, k), np.int8)
    best = np.zeros((n, k))
    for a in range(0, length, piece):
        scores = score(a, min(length, a + piece))
        for t in range(a, min(length, a + piece)):
            if t == 0:
                best = scores[:, 0] + move[0]
                continue
            reach = best[:, :, None] + move
            back[:, t] = reach.argmax(1)
            best = np.where((t < sizes)[:, None], reach.max(1) + scores[:, t - a], best)
    last = (best + move[:, 0]).argmax(1)
    out = np.zeros((n, length), np.int8)
    rows = np.arange(n)
    for t in range(length - 1, -1, -1):
        on = t < sizes
        out[on, t] = last[on]
        last = np.where(on, back[rows, t, last], last)
    return out


#: Words of a batch of stretches, and of a piece of a long one.
BATCH, PIECE = 1 << 16, 1 << 14


class Decoder:
    """Decodes texts in batches; the shapes of words are remembered, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.table = model.emit.reshape(len(_WINDOW), FEATURES + 1, -1)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids: dict[tuple[int, ...], int] = {}
        self.gains: list[np.ndarray] = [self.table[:, _EDGE]]  # what a shape adds to the scores of the words around it
        self.stack: np.ndarray | None = None

    def shape(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            on = shape(word)
            found = self.ids.get(on)
            if found is None:
                found = self.ids[on] = len(self.gains)
                self.gains.append(self.table[:, list(on)].sum(1))
                self.stack = None
            if len(word) <= 64 and len(self.known) < 200_000:
                self.known[word] = found
        return found

    def stretches(self, text: str) -> Iterator[list[tuple[int, int]]]:
        """Runs of words, as spans, around the marked ones, with two more words on either side."""
        group: list[tuple[int, int]] = []
        done = 0
        for m in _MARK.finditer(text):
            if m.start() < done:
                continue
            a = m.start()
            while a > done and text[a - 1] not in _BLANK:
                a -= 1
            stop = _STOP.search(text, m.end())
            done = stop.start() if stop else len(text)
            near = [*_before(text, a, 2), (a, done)]
            if group and near[0][0] <= group[-1][1]:
                group += [w for w in near if w[0] > group[-1][0]]
            else:
                if group:
                    yield group
                group = near
            after = [w.span() for w, _ in zip(_TOKEN.finditer(text, done), range(2), strict=False)]
            group += [w for w in after if w[0] > group[-1][0]]
        if group:
            yield group

    def labels(self, runs: list[list[str]]) -> np.ndarray:
        """Labels (runs, longest) of runs of words."""
        sizes = np.array([len(r) for r in runs])
        longest = int(sizes.max())
        ids, bar = np.zeros((len(runs), longest + 4), np.int32), np.zeros((len(runs), longest), bool)
        for i, words in enumerate(runs):
            ids[i, 2 : 2 + len(words)] = [self.shape(w) for w in words]
            bar[i, : len(words)] = barred(words)
        if self.stack is None:
            self.stack = np.stack(self.gains)

        def score(a: int, b: int) -> np.ndarray:
            out = sum(self.stack[ids[:, a + 2 + d : b + 2 + d], j] for j, d in enumerate(_WINDOW))
            out[bar[:, a:b], 1:] += _BARRED
            return out

        return viterbi(score, longest, sizes, self.model.move, PIECE)

    def decode(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        if len(self.gains) > 20_000:
            self.forget()
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        runs = [(i, words) for i, t in enumerate(texts) for words in self.stretches(t)]
        runs.sort(key=lambda r: len(r[1]))
        a = 0
        while a < len(runs):
            length = len(runs[a][1])
            b = a
            while b < len(runs) and len(runs[b][1]) <= length * 1.25 + 2 and (b == a or (b - a) * len(runs[b][1]) < BATCH):
                b += 1
            found = self.labels([[texts[i][x:y] for x, y in words] for i, words in runs[a:b]])
            for (i, words), labels in zip(runs[a:b], found, strict=True):
                if labels.any():
                    out[i] += _spans(texts[i], words, labels[: len(words)])
            a = b
        return [sorted(found, key=lambda x: x[1]) for found in out]


_MARK = re.compile(r"[0-9@+]")
_STOP = re.compile(r"[\x20\x09-\x0D]")
_BLANK = frozenset(" \t\n\r\x0b\x0c")


def _before(text: str, at: int, n: int) -> list[tuple[int, int]]:
    """The n words that end before `at`."""
    out: list[tuple[int, int]] = []
    while len(out) < n:
        while at > 0 and text[at - 1] in _BLANK:
            at -= 1
        if not at:
            break
        end = at
        while at > 0 and text[at - 1] not in _BLANK:
            at -= 1
        out.insert(0, (at, end))
    return out


def _spans(text: str, words: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
    out, i = [], 0
    while i < len(words):
        label = LABELS[labels[i]]
        if label[0] != "B":
            i += 1
            continue
        j = i + 1
        while j < len(words) and LABELS[labels[j]] == "I-" + label[2:]:
            j += 1
        kind, a, b = label[2:], words[i][0], words[j - 1][1]
        if kind == "secret":  # the value behind a name, if there is one
            name = _NAMED.match(text, a, b)
            a = name.end() if name else a
        while a < b and text[a] in "\"'<[{,;:=":
            a += 1
        while b > a and text[b - 1] in "\"'>]},;:.!?":
            b -= 1
        if _holds(kind, text[a:b]):
            out.append((kind, a, b))
        i = j
    return out


_NAMED = re.compile(r"[A-Za-z_-]{2,}[=:]")
_NUMBERS = re.compile(r"[+(0-9][0-9 ()./\-\t]*[0-9]")
_VALUE = re.compile(r"(?=\S*[0-9])\S{8,256}")


def _holds(kind: str, text: str) -> bool:
    """What a span of each kind holds at least: numbers have no letters, and card numbers pass Luhn."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "email":
        return "@" in text[1:-1]
    if kind == "ip":
        return bool(_QUADS.match(text))
    if kind == "secret":
        return bool(_VALUE.fullmatch(text))
    if not _NUMBERS.fullmatch(text):
        return False
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def find(texts: list[str], decoder: Decoder) -> list[tuple]:
    rows = []
    for text, more in zip(texts, decoder.decode(texts), strict=True):
        base = base_spans(text)
        taken = sorted(s for spans in base.values() for s in spans)
        free = [(k, a, b) for k, a, b in more if not any(x < b and a < y for x, y in taken)]
        fixed = [(KINDS.index(k), a, b) for k in KINDS for a, b in base[k]]
        every = sorted({*fixed, *((ALL_KINDS.index(k), a, b) for k, a, b in free)})
        line = lambda spans: ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in spans)
        rows.append((*(len(base[k]) for k in KINDS), hashlib.sha256(line(sorted(fixed)).encode()).hexdigest(), line(every), len(every)))
    return rows


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans and their number, for every row of docs."""
    model = trained()
    kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = find([t or "" for t in part.column("text").to_pylist()], decoder)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCHEMA)
