"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus signs, digits, `://` and cues
such as "iban" or "password". Each anchor starts a small deterministic parser that expands to the
left and to the right up to the boundaries of an e-mail address, a network address, a card, phone
or account number, and validates what it holds. A parser never looks at a place twice per kind,
so the work is linear in the text, whatever it holds.

Base kinds are the leftmost non-overlapping matches of these patterns, those that fail their check
being dropped without a second try:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)           parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                           12 to 19 digits that pass Luhn's check
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                      9 to 15 digits

Added kinds are `url` (a known scheme with a valid host), `account` (a valid IBAN, social security,
account or passport number behind its cue) and `secret` (a value with a digit behind a cue for
passwords or keys).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds in the order of the contract, then those that the method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")
RANK = {kind: i for i, kind in enumerate(KINDS)}
SCHEMES = frozenset(("http", "https", "ftp", "ftps", "sftp", "ssh", "ws", "wss", "git", "ldap", "imap", "smtp", "smb"))
# Cues in lower case, with the parser of what follows them.
CUES = {
    "iban": "iban",
    "ssn": "ssn",
    "social security": "ssn",
    "account": "number",
    "acct": "number",
    "konto": "number",
    "cuenta": "number",
    "compte": "number",
    "passport": "passport",
    "pasaporte": "passport",
    "passeport": "passport",
    "reisepass": "passport",
    "password": "secret",
    "passwd": "secret",
    "passwort": "secret",
    "token": "secret",
    "secret": "secret",
    "api_key": "secret",
    "apikey": "secret",
    "access_key": "secret",
}
NAMING = ("number", "nummer", "no", "nr", "num", "id", "key")  # fixed values: words between a cue and its value

DIGIT = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = DIGIT | UPPER | frozenset("abcdefghijklmnopqrstuvwxyz")
LABEL = ALNUM | {"-"}
LOCAL = LABEL | frozenset("._%+")
PHONE = DIGIT | frozenset(" ().-")
LINK_END = frozenset(" \t\n\r\v\f<>\"'`{}|\\^")
GAP = frozenset(" :=#.\"'")
VALUE = ALNUM | frozenset("_-+/.=~$!%&*")
GAP_LONGEST, NUMBER_LONGEST, SECRET_SHORTEST = 12, 40, 8

Span = tuple[int, int, str]


def automaton() -> ahocorasick.Automaton:
    """All anchors, each with the name of its parser."""
    anchors = {"@": "email", "+": "phone", "://": "url"} | {d: "digit" for d in DIGIT}
    for cue, parser in CUES.items():
        anchors |= {form: parser for form in (cue, cue.capitalize(), cue.upper())}
    built = ahocorasick.Automaton()
    for anchor, parser in anchors.items():
        built.add_word(anchor, (parser, len(anchor)))
    built.make_automaton()
    return built


def over(text: str, start: int, chars: frozenset, limit: int | None = None) -> int:
    """End of the stretch of given characters from start, at the limit at the latest."""
    end = len(text) if limit is None else min(len(text), limit)
    while start < end and text[start] in chars:
        start += 1
    return start


def before(text: str, end: int, chars: frozenset, floor: int) -> int:
    """Start of the stretch of given characters that ends here, not below floor."""
    while end > floor and text[end - 1] in chars:
        end -= 1
    return end


def labels(text: str, start: int) -> tuple[int, int]:
    """End of a dotted name from start and its number of labels."""
    end = over(text, start, LABEL)
    count = int(end > start)
    while count and end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = over(text, end + 1, LABEL)
        count += 1
    return end, count


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        twice = int(d) * (1 + place % 2)
        total += twice - 9 if twice > 9 else twice
    return total % 10 == 0


def email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = before(text, at, LOCAL, floor)
    if start == at:
        return None
    end, count = labels(text, at + 1)
    return (start, end) if count > 1 else None


def address(text: str, start: int) -> tuple[int, bool]:
    """End of up to four dotted numbers from start, and whether they are an address."""
    end, valid = start, True
    for part in range(4):
        if part:
            if end + 1 >= len(text) or text[end] != "." or text[end + 1] not in DIGIT:
                return end, False
            end += 1
        begin, end = end, over(text, end, DIGIT)
        number = text[begin:end].lstrip("0")
        valid = valid and len(number) <= 3 and int(number or 0) <= 255
    return end, valid


def spaced_digits(text: str, start: int) -> tuple[int, int]:
    """End of digits from start with single spaces or hyphens between them, and their number."""
    end, count, n = start, 0, len(text)
    while True:
        stop = over(text, end, DIGIT)
        count += stop - end
        if stop + 1 < n and text[stop] in " -" and text[stop + 1] in DIGIT:
            end = stop + 1
        else:
            return stop, count


def phone(text: str, plus: int) -> tuple[int, int]:
    """End of the pattern behind a plus sign (0 if it does not match), and its number of digits."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGIT:
        return 0, 0
    end = over(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGIT:
        end -= 1
    if end < plus + 4:
        return 0, 0
    return end, sum(c in DIGIT for c in text[plus:end])


def link(text: str, colon: int, floor: int) -> tuple[int, int] | None:
    start = before(text, colon, ALNUM, floor)
    if text[start:colon].lower() not in SCHEMES:
        return None
    end = colon + 3
    while end < len(text) and text[end] not in LINK_END:
        end += 1
    while end > colon + 3 and text[end - 1] in ".,;:!?)]":
        end -= 1
    host = colon + 3
    authority = text[host:end].split("/", 1)[0].split("?", 1)[0].split("#", 1)[0]
    host += authority.rfind("@") + 1
    stop, count = labels(text, host)
    last = text[host:stop].rsplit(".", 1)[-1]
    named = count > 1 and len(last) > 1 and last.isalpha()
    numeric, valid = address(text, host)
    return (start, end) if named or valid and numeric == stop else None


def behind_cue(text: str, end: int) -> int:
    """Start of the value behind a cue, past signs, spaces and words like "number"; -1 if none."""
    limit = end + GAP_LONGEST
    start = over(text, end, GAP, limit)
    for word in NAMING:
        stop = start + len(word)
        if start > end and text[start:stop].lower() == word and stop < len(text) and text[stop] in GAP:
            start = over(text, stop, GAP, stop + GAP_LONGEST)
            break
    return start if end < start < len(text) else -1


def iban(text: str, start: int) -> int:
    """End of an international account number whose remainder by 97 is one; 0 if there is none."""
    end, kept = start, ""
    while end < len(text) and end < start + NUMBER_LONGEST and len(kept) < 34:
        c = text[end].upper()
        if c in DIGIT or c in UPPER:
            kept += c
        elif c != " " or not kept:
            break
        end += 1
    for length in range(len(kept), 14, -1):  # a following word may have been taken along
        part = kept[:length]
        if part[:2].isalpha() and part[2:4].isdigit():
            turned = "".join(str(int(c, 36)) for c in part[4:] + part[:4])
            if int(turned) % 97 == 1:
                place = start
                while length:
                    length -= text[place] != " "
                    place += 1
                return place if place >= len(text) or text[place] not in ALNUM else 0
    return 0


def account(text: str, start: int, parser: str) -> int:
    """End of the value of a cue, 0 if it does not validate."""
    if parser == "iban":
        return iban(text, start)
    if parser == "secret":
        end = over(text, start, VALUE)
        while end > start and text[end - 1] in ".!,":
            end -= 1
        return end if end - start >= SECRET_SHORTEST and any(c in DIGIT for c in text[start:end]) else 0
    if parser == "passport":
        letters = over(text, start, UPPER, start + 2)
        end = over(text, letters, DIGIT, letters + 10)
        good = 6 <= end - letters <= 9
    else:
        end, count = spaced_digits(text, start)
        value = text[start:end]
        if parser == "ssn":
            parts = value.replace(" ", "-").split("-")
            shape = [len(p) for p in parts]
            good = shape == [3, 2, 4] and parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000"
        else:
            good = 6 <= count <= 17
    return end if good and (end >= len(text) or text[end] not in ALNUM) else 0


def find(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """(start, end, kind) of all spans, by start and then by the order of the kinds."""
    spans: list[Span] = []
    done = dict.fromkeys((*KINDS, "run"), 0)  # per kind the place up to which the text is settled
    for last, (parser, width) in anchors.iter(text):
        start = last + 1 - width
        if parser == "digit":
            if start >= done["ip"]:
                done["ip"], valid = address(text, start)
                if valid:
                    spans.append((start, done["ip"], "ip"))
            if start >= done["card"]:
                done["card"], count = spaced_digits(text, start)
                if 12 <= count <= 19 and luhn("".join(c for c in text[start : done["card"]] if c in DIGIT)):
                    spans.append((start, done["card"], "card"))
        elif parser == "email":
            if start >= done["email"] and (found := email(text, start, done["email"])):
                spans.append((*found, "email"))
                done["email"] = found[1]
        elif parser == "phone":
            if start >= done["phone"]:
                end, count = phone(text, start)
                done["phone"] = max(end, start)
                if 9 <= count <= 15:
                    spans.append((start, end, "phone"))
        elif parser == "url":
            if start >= done["url"] and (found := link(text, start, done["url"])):
                spans.append((*found, "url"))
                done["url"] = found[1]
        elif (start == 0 or text[start - 1] not in ALNUM) and (value := behind_cue(text, last + 1)) >= 0:
            kind = "secret" if parser == "secret" else "account"
            if value >= done[kind] and (end := account(text, value, parser)):
                spans.append((value, end, kind))
                done[kind] = end
    return sorted(spans, key=lambda s: (s[0], RANK[s[2]]))


def detect(documents: DataFrame) -> DataFrame:
    """(doc_id, spans) per row; spans is an array of (kind, start, end) in code points, end exclusive.

    Spans are ordered by start, then by kind. A null or empty text has none. Repeated rows give
    repeated results, a null doc_id stays null, an empty table gives none; only doc_id and text
    are read, so other columns may have any names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for batch in batches:
            found = [find(t, anchors) if isinstance(t, str) and t else [] for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "spans": [[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in found],
                }
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(documents: DataFrame) -> DataFrame:
    """The documents with every span of every kind replaced by its kind in angle brackets.

    Overlapping spans become one mark, of the kind that starts first. All columns stay.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        anchors = automaton()
        for batch in batches:
            yield batch.map(lambda t: mask(t, find(t, anchors)) if isinstance(t, str) and t else t)

    clean = F.pandas_udf(run, "string")
    return documents.withColumn("text", clean(F.col("text").cast("string")))


def mask(text: str, spans: list[Span]) -> str:
    parts, place = [], 0
    for start, end, kind in spans:
        if start >= place:
            parts += [text[place:start], f"<{kind}>"]
        place = max(place, end)
    return "".join([*parts, text[place:]])


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans as text, per row."""
    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*BASE_KINDS)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
