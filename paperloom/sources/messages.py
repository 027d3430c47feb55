"""Emails and chat exports as rows of messages."""

from __future__ import annotations

import email
import email.policy
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.quoprimime import header_decode
from email.utils import getaddresses, parsedate_to_datetime
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.sources.markup import html_to_text

MAX_ATTACHMENTS = 256
EMAIL_SCHEMA = "message_id string, subject string, from_addrs array<string>, to_addrs array<string>, cc_addrs array<string>, date string, body string, attachment_names array<string>, dropped_attachments int"
#: Messages and characters of bodies from which on rows read are handed over.
ROWS_AT_ONCE, TEXT_AT_ONCE = 10_000, 16_000_000
MESSAGE_SCHEMA = "platform string, title string, position int, day string, time string, sender string, text string, attachments array<string>"


def split_mbox(text: str) -> list[str]:
    """Messages of an mbox: they begin at lines that start with 'From '."""
    parts = re.split(r"(?m)^From [^\n]*\n", text)
    return [p for p in parts if p.strip()]


def _utc(when: datetime) -> str:
    return (when if when.tzinfo else when.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def read_email(raw: bytes | str) -> dict:
    """One message: decoded headers, plain body (else the text of its HTML), names of attachments; inline pictures are none."""
    data = raw.encode("utf-8", "surrogateescape") if isinstance(raw, str) else bytes(raw)
    message = email.message_from_bytes(data, policy=email.policy.default)
    people = lambda name: [f"{n} <{a}>" if n else a for n, a in getaddresses(message.get_all(name, [])) if a or n]
    try:
        when = parsedate_to_datetime(message["date"]) if message["date"] else None
    except (TypeError, ValueError):
        when = None
    part = message.get_body(("plain", "html"))
    body = ""
    if part is not None:
        try:
            body = part.get_content()
        except (LookupError, ValueError):
            body = (part.get_payload(decode=True) or b"").decode("utf-8", "replace")
        if part.get_content_type() == "text/html":
            body = html_to_text(body)[0]
    names, dropped = [], 0
    for item in message.iter_attachments() if message.is_multipart() else []:
        if item.get("content-id") and item.get_content_disposition() != "attachment":
            continue
        if len(names) >= MAX_ATTACHMENTS:
            dropped += 1
            continue
        name = re.split(r"[/\\]", item.get_filename() or "attachment")[-1].lstrip(".") or "attachment"
        names.append(name)
    date = None if when is None else _utc(when)
    mid = (message["message-id"] or "").strip() or None
    return {"message_id": mid, "subject": str(message["subject"]) if message["subject"] is not None else None, "from_addrs": people("from"), "to_addrs": people("to"), "cc_addrs": people("cc"), "date": date, "body": body, "attachment_names": names, "dropped_attachments": dropped}


_ADDRESS = r"[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*"
_MAILBOX = rf"(?:\w+(?: \w+)* <{_ADDRESS}>|{_ADDRESS})"
_PLAIN_HEAD = re.compile(r"(?:[!-9;-~]+:[ -~]*\n)+\n")
_PLAIN_PEOPLE = re.compile(rf"{_MAILBOX}(?:, {_MAILBOX})*", re.A)
_PLAIN_ID = re.compile(rf"<{_ADDRESS}>", re.A)
_PLAIN_DATE = re.compile(r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [12]\d{3} \d\d:\d\d:\d\d [+-]\d{4}", re.A)
_PLAIN_WORDS = re.compile(r"[!-~]+(?: [!-~]+)*")
_PLAIN_TYPE = re.compile(r"text/plain(?:; ?charset=(\"?)(utf-8|us-ascii)\1)?", re.I)
_ENCODED_WORD = re.compile(r"=\?utf-8\?q\?((?:[!-<>@-~]|=[0-9a-f]{2})+)\?=", re.I)
_READ_HEADERS = frozenset(("message-id", "subject", "from", "to", "cc", "date", "content-type"))


@lru_cache(maxsize=4096)
def _plain_date(value: str) -> str | None:
    """A date of the usual form in UTC; None of any other."""
    try:
        return _utc(parsedate_to_datetime(value)) if _PLAIN_DATE.fullmatch(value) else None
    except ValueError:
        return None


def _plain_subject(value: str) -> str | None:
    """Printable ASCII words or one encoded word as text; None of any other."""
    if "=?" not in value:
        return value if _PLAIN_WORDS.fullmatch(value) else None
    word = _ENCODED_WORD.fullmatch(value)
    if word is None:
        return None
    try:
        text = header_decode(word[1]).encode("latin-1").decode("utf-8")
    except ValueError:
        return None
    return text if text.isprintable() else None


def read_plain_email(text: str) -> tuple | None:
    """The fields of EMAIL_SCHEMA as `read_email` gives them, where a message is one plain text under unfolded headers of
    usual forms; None where it is anything else, which takes the whole parser (a hundred times the time)."""
    head = _PLAIN_HEAD.match(text)
    if head is None or "\r" in text:
        return None
    got: dict[str, str] = {}
    for line in text[: head.end() - 2].split("\n"):
        name, _, value = line.partition(":")
        name = name.lower()
        if name in _READ_HEADERS:
            if name in got:
                return None
            got[name] = value.lstrip(" ")
        elif name.startswith("content-"):
            return None
    kind = _PLAIN_TYPE.fullmatch(got.get("content-type", "text/plain"))
    body = text[head.end() :]
    if kind is None:
        return None
    if not body.isascii():
        if (kind[2] or "").lower() != "utf-8":
            return None
        try:
            body.encode("utf-8")
        except UnicodeEncodeError:  # bytes that are no UTF-8
            return None
    mid, subject, date = got.get("message-id"), got.get("subject"), got.get("date")
    if mid is not None and not _PLAIN_ID.fullmatch(mid):
        return None
    if subject is not None and (subject := _plain_subject(subject)) is None:
        return None
    if date is not None and (date := _plain_date(date)) is None:
        return None
    people: list[list[str]] = []
    for name in ("from", "to", "cc"):
        value = got.get(name)
        if value is not None and not _PLAIN_PEOPLE.fullmatch(value):
            return None
        people.append([] if value is None else value.split(", "))
    return mid, subject, *people, date, body, [], 0


def email_rows(df: DataFrame, key: str, raw: Column, mbox: bool = False) -> DataFrame:
    """`key`, `position` (from 1) and the fields of each message; bytes that are no message give null fields, not an error."""
    own = df.select(F.col(key).alias("_id"), raw.alias("_raw")).where("_raw IS NOT NULL")
    kind = own.schema["_id"].dataType.simpleString()
    names = [c.split()[0] for c in EMAIL_SCHEMA.split(", ")]
    types = {"int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    fields = [types[c.split()[1]] for c in EMAIL_SCHEMA.split(", ")]

    def rows_of(batch: pa.RecordBatch, at: list[int], positions: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), fields)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(positions, pa.int32()), *columns], names=["_id", "position", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, positions, rows, size = [], [], [], 0
            for i, data in enumerate(batch.column(1)):
                data = data.as_py()
                data = data if isinstance(data, str) else data.decode("utf-8", "surrogateescape")
                for n, m in enumerate(split_mbox(data) if mbox else [data], 1):
                    rows.append(read_plain_email(m) or tuple(map(read_email(m).get, names)))
                    at.append(i)
                    positions.append(n)
                    size += len(m)
                    if len(rows) >= ROWS_AT_ONCE or size >= TEXT_AT_ONCE:
                        yield rows_of(batch, at, positions, rows)
                        at, positions, rows, size = [], [], [], 0
            if rows:
                yield rows_of(batch, at, positions, rows)

    return own.mapInArrow(run, f"_id {kind}, position int, {EMAIL_SCHEMA}").withColumnRenamed("_id", key)


_MARKS = dict.fromkeys([0x200E, 0x200F, *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0xFEFF])
_PHONE_LINE = re.compile(r"^\[?(\d{1,4})[./-](\d{1,2})[./-](\d{1,4}),? (\d{1,2}):(\d{2})(?::(\d{2}))?(?:[\s ]?([AaPp])\.?[Mm]\.?)?\]?(?: -)? (.*)$", re.S)


def _day(order: str, a: int, b: int, c: int) -> str | None:
    y, m, d = (a, b, c) if order == "ymd" else (c, b, a) if order == "dmy" else (c, a, b)
    y += 2000 if y < 100 else 0
    try:
        return datetime(y, m, d).strftime("%Y-%m-%d")
    except ValueError:
        return None


def whatsapp(text: str) -> list[tuple]:
    """Messages of an exported chat: (day, time, sender, text, attachments). Lines without a stamp continue the message before."""
    lines = [x.translate(_MARKS) for x in text.replace("\r\n", "\n").split("\n")]
    stamps = [m for m in map(_PHONE_LINE.match, lines) if m]
    first = [(int(m[1]), int(m[2]), int(m[3])) for m in stamps]
    if any(a > 31 for a, _, _ in first):
        order = "ymd"
    elif any(a > 12 for a, _, _ in first):
        order = "dmy"
    else:
        order = "mdy" if any(b > 12 for _, b, _ in first) else "dmy"
    out: list[list] = []
    for line in lines:
        m = _PHONE_LINE.match(line)
        day = _day(order, int(m[1]), int(m[2]), int(m[3])) if m else None
        if not m or day is None:
            if out and line.strip():
                out[-1][3] += "\n" + line
            continue
        hour = int(m[4]) % 12 + 12 * (m[7].lower() == "p") if m[7] else int(m[4])
        sender, sep, body = m[8].partition(": ")
        if not sep or len(sender) > 64:
            sender, body = None, m[8]
        out.append([day, f"{hour:02d}:{m[5]}" + (f":{m[6]}" if m[6] else ""), sender, body, []])
    for row in out:
        for pattern in (r"<attached: ([^>]+)>", r"^(\S[^\n]*?) \(file attached\)"):
            for name in re.findall(pattern, row[3]):
                row[4].append(name)
            row[3] = re.sub(pattern, "", row[3]).strip()
    return [tuple(r) for r in out]


def _flat(node) -> str:
    if isinstance(node, list):
        return "".join(_flat(x) for x in node)
    if isinstance(node, dict):
        href = node.get("href")
        return _flat(node.get("text", "")) + (f" ({href})" if href else "")
    return str(node or "")


def telegram(text: str) -> list[tuple[str, list[tuple]]]:
    """Chats of a result.json, as (title, messages); service actions stand in brackets, media that isn't included is named."""
    data = json.loads(text)
    chats = [data] if "messages" in data else [c for key in ("chats", "left_chats") for c in (data.get(key) or {}).get("list", [])]
    out = []
    for chat in chats:
        rows = []
        for m in chat.get("messages", []):
            stamp = str(m.get("date") or "")
            day, time = (stamp[:10], stamp[11:19]) if len(stamp) >= 19 else (None, None)
            body, files = _flat(m.get("text")), []
            if m.get("type") == "service":
                body = f"[{str(m.get('action', 'service')).replace('_', ' ')}] " + (m.get("title") or body or "").strip()
            if m.get("forwarded_from"):
                body = f"Forwarded from {m['forwarded_from']}\n{body}".strip()
            for kind in ("photo", "file"):
                value = m.get(kind)
                if isinstance(value, str):
                    if value.startswith("("):
                        body = f"{body}\n[{m.get('media_type', kind).replace('_', ' ')}: not included]".strip()
                    else:
                        files.append(value)
            if place := m.get("location_information"):
                body = f"{body}\n[location: {place.get('latitude')}, {place.get('longitude')}]".strip()
            if card := m.get("contact_information"):
                body = f"{body}\n[contact: {' '.join(filter(None, (card.get('first_name'), card.get('last_name'), card.get('phone_number'))))}]".strip()
            if poll := m.get("poll"):
                body = f"{body}\n[poll: {poll.get('question')}]\n" + "\n".join(f"- {a.get('text')}: {a.get('voters')}" for a in poll.get("answers", []))
            rows.append((day, time, m.get("from") or m.get("actor"), body.strip(), files))
        out.append((chat.get("name") or "Saved messages", rows))
    return out


def slack_text(text: str, users: dict[str, str], channels: dict[str, str] | None = None) -> str:
    """Markup of a message as plain text."""
    text = re.sub(r"<@(\w+)(?:\|([^>]*))?>", lambda m: "@" + (m[2] or users.get(m[1], m[1])), text)
    text = re.sub(r"<#(\w+)(?:\|([^>]*))?>", lambda m: "#" + (m[2] or (channels or {}).get(m[1], m[1])), text)
    text = re.sub(r"<!(\w+)(?:[^>|]*)(?:\|([^>]*))?>", lambda m: "@" + (m[2] or m[1]).lstrip("@"), text)
    text = re.sub(r"<([^>|]+)\|([^>]+)>", r"\2 (\1)", text)
    text = re.sub(r"<([^>]+)>", r"\1", text)
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")


def slack_names(users: list[dict]) -> dict[str, str]:
    """Names by user id: display name, else real name, else account name, else the id."""
    out = {}
    for u in users:
        profile = u.get("profile") or {}
        names = (profile.get("display_name"), profile.get("real_name"), u.get("real_name"), u.get("name"), u["id"])
        out[u["id"]] = next(n for n in names if n)
    return out


def slack_day(messages: list[dict], users: dict[str, str]) -> list[tuple]:
    """Messages of a day file; replies in a thread are marked, times are UTC."""
    out = []
    for m in messages:
        if m.get("type") != "message":
            continue
        at = datetime.fromtimestamp(float(m["ts"]), timezone.utc)
        body = slack_text(m.get("text") or "", users)
        if m.get("thread_ts") and m["thread_ts"] != m["ts"]:
            body = "(thread reply) " + body
        who = users.get(m.get("user"), m.get("user") or m.get("username") or m.get("bot_id"))
        out.append((at.strftime("%Y-%m-%d"), at.strftime("%H:%M:%S"), who, body, [f.get("name") or f.get("title") or f["id"] for f in m.get("files", [])]))
    return out


def slack_messages(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Messages of day files (`user`, `text`, `ts`, `thread_ts`) with the names of `users` (`user`, `name`): adds `day`, `time` (UTC) and `sender`.

    Users named in the text are looked up too, by a join on the ids that each message names; an unknown id stands for itself.
    """
    own = rows.withColumn("_row", F.monotonically_increasing_id())
    named = own.select("_row", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"<@(\w+)"), F.lit(1)))).alias("user")).join(users, "user")
    names = named.groupBy("_row").agg(F.map_from_entries(F.collect_set(F.struct("user", "name"))).alias("_names"))  # of one message
    whole = own.join(names, "_row", "left").join(users.withColumnRenamed("name", "_sender"), "user", "left")
    plain = F.pandas_udf(lambda t, n: pd.Series([None if x is None else slack_text(x, dict(m) if m is not None else {}) for x, m in zip(t, n)]), "string")
    body = plain(F.col("text"), F.col("_names"))
    reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts"))
    at = F.timestamp_seconds(F.col("ts").cast("double"))
    stamped = whole.withColumns({"text": F.when(reply, F.concat(F.lit("(thread reply) "), body)).otherwise(body), "day": F.date_format(at, "yyyy-MM-dd"), "time": F.date_format(at, "HH:mm:ss"), "sender": F.coalesce("_sender", "user")})
    return stamped.drop("_row", "_names", "_sender")


_IM = re.compile(r"^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) +(\d{1,2}):(\d{2}):(\d{2})[\s ]([AP])M(?: \(.*\))?$")


def imessage(text: str) -> list[tuple]:
    """Blocks of a date line, a sender and a body; lines that are only a path are attachments."""
    out: list[list] = []
    lines = text.replace("\r\n", "\n").split("\n")
    months = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
    fresh = True
    for line in lines:
        m = _IM.match(line.strip()) if fresh else None
        fresh = not line.strip()
        if m and m[1] in months:
            hour = int(m[4]) % 12 + 12 * (m[7] == "P")
            out.append([f"{m[3]}-{months[m[1]]:02d}-{int(m[2]):02d}", f"{hour:02d}:{m[5]}:{m[6]}", None, [], []])
        elif out and line.strip():
            row = out[-1]
            if row[2] is None:
                row[2] = line.strip()
            elif re.fullmatch(r"(?:~|/|[A-Za-z]:\\)\S[^\n]*\.\w{2,5}", line.strip()):
                row[4].append(line.strip())
            else:
                row[3].append(line)
    return [(a, b, c, "\n".join(d), e) for a, b, c, d, e in out]


def chat_rows(df: DataFrame, key: str, text: str, platform: str) -> DataFrame:
    """Messages of whole exports, one per row of `df`: whatsapp, telegram or imessage. A text that can't be read has no messages."""
    own = df.select(F.col(key).alias("_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    kind = own.schema["_id"].dataType.simpleString()

    def chats(body: str):
        if platform == "telegram":
            try:
                return telegram(body)
            except (ValueError, AttributeError, TypeError):
                return []
        return [(None, (whatsapp if platform == "whatsapp" else imessage)(body))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, platform, title, n, *m) for i, body in zip(batch["_id"], batch["_text"]) for title, messages in chats(body) for n, m in enumerate(messages, 1)]
            yield pd.DataFrame(rows, columns=["_id", *(c.split()[0] for c in MESSAGE_SCHEMA.split(", "))])

    return own.mapInPandas(run, f"_id {kind}, {MESSAGE_SCHEMA}").withColumnRenamed("_id", key)


def chat_units(messages: DataFrame, key: str, limit: int = 12 * 1024) -> DataFrame:
    """Chats laid out as units of about `limit` bytes: a heading, a line per day, `time sender: text`; later units are marked as continued."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        first = group.iloc[0]
        head = f"{first['platform']} chat: {first['title'] or 'chat'}"
        people = list(dict.fromkeys(s for s in group["sender"] if s))
        days = [d for d in group["day"] if d]
        lines = [head, f"Participants: {', '.join(people)}", f"Messages: {len(group)}" + (f" ({days[0]} to {days[-1]})" if days else "")]
        out, day, size, fresh = [], None, 0, True
        for m in group.itertuples(index=False):
            if m.day and (m.day != day or fresh):
                lines.append(f"\n-- {m.day} --")
            day, fresh = m.day, False
            body = (m.text or "").split("\n")
            notes = "".join(f" [file: {a}]" for a in (m.attachments if m.attachments is not None else []))
            lines.append(" ".join(filter(None, (m.time, f"{m.sender}:" if m.sender else None, body[0]))) + notes)
            lines += ["    " + x for x in body[1:]]
            size = sum(len(x.encode()) + 1 for x in lines)
            if size >= limit:
                out.append("\n".join(lines))
                lines, fresh = [head + " (continued)"], True
        if len(lines) > 1 or not out:
            out.append("\n".join(lines))
        return pd.DataFrame({key: [first[key]] * len(out), "unit_no": range(1, len(out) + 1), "text": out})

    kind = messages.schema[key].dataType.simpleString()
    return messages.groupBy(key).applyInPandas(run, f"{key} {kind}, unit_no int, text string")
