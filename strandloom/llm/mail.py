"""Reading a stored mail as a mail program shows it: subject and text parts."""

from __future__ import annotations

import binascii
import html
import re

# Elements that begin a new line or cell when shown.
BLOCK_TAGS = (
    "address|article|aside|blockquote|body|br|caption|center|dd|div|dl|dt|fieldset|figure|footer|form|"
    "h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul"
)
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(rf"</?(?:{BLOCK_TAGS})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^>]*>|<![^>]*>|<\?[^>]*>")
_FOLD = re.compile(r"\n[ \t]+")
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?]*)\?=")
_BETWEEN = re.compile(r"(\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?)")
_PARAM = re.compile(r";\s*([\w*-]+)\s*=\s*(?:\"((?:[^\"\\]|\\.)*)\"|([^;\s]*))")
_NOT64 = re.compile(rb"[^A-Za-z0-9+/]")


def _decode(raw: bytes, charset: str | None) -> str:
    try:
        return raw.decode(charset or "utf-8", errors="replace")
    except (LookupError, ValueError):
        return raw.decode("utf-8", errors="replace")


def _base64(text: str) -> bytes:
    raw = _NOT64.sub(b"", text.encode("ascii", "ignore"))
    if len(raw) % 4 == 1:
        raw = raw[:-1]
    return binascii.a2b_base64(raw + b"=" * (-len(raw) % 4))


def header_words(value: str) -> str:
    """Encoded words resolved; blanks between two of them are layout."""
    if "=?" not in value:
        return value
    value = _BETWEEN.sub(r"\1", value)
    out, last, raw, charset = [], 0, b"", None
    for m in _WORD.finditer(value):
        name = m[1].split("*")[0].lower()
        if raw and (m.start() > last or name != charset):
            out.append(_decode(raw, charset))
            raw = b""
        out.append(value[last : m.start()])
        data = _base64(m[3]) if m[2] in "bB" else binascii.a2b_qp(m[3].encode("utf-8", "replace"), header=True)
        raw, charset, last = raw + data, name, m.end()
    if raw:
        out.append(_decode(raw, charset))
    out.append(value[last:])
    return "".join(out)


def shown(markup: str) -> str:
    """The text of HTML: markup dropped, entities resolved."""
    text = _HIDDEN.sub(" ", markup)
    return html.unescape(_TAG.sub("", _BLOCK.sub("\n", text)))


def _head(text: str) -> tuple[dict[str, str], str]:
    if text.startswith("\n"):
        return {}, text[1:]
    head, _, body = text.partition("\n\n")
    fields: dict[str, str] = {}
    for line in _FOLD.sub(" ", head).split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            fields.setdefault(name.strip().lower(), value.strip())
    return fields, body


def _params(value: str) -> dict[str, str]:
    return {m[1].lower(): m[2] if m[2] is not None else m[3] for m in _PARAM.finditer(value)}


def _text_parts(fields: dict[str, str], body: str) -> list[str]:
    """The text parts of a mail in order, however deeply multiparts are nested."""
    out: list[str] = []
    todo = [(fields, body)]
    while todo:
        fields, body = todo.pop()
        kind = fields.get("content-type", "text/plain")
        main = kind.partition(";")[0].strip().lower()
        boundary = _params(kind).get("boundary") if main.startswith("multipart/") else None
        if boundary:
            pieces = re.split(rf"\n--{re.escape(boundary)}(--)?[ \t]*(?=\n|\Z)", "\n" + body)
            own = []
            for end, piece in zip(pieces[1::2], pieces[2::2]):
                if end:
                    break
                own.append(_head(piece[1:]))
            todo += reversed(own)
            continue
        if main == "message/rfc822":
            todo.append(_head(body))
            continue
        if not main.startswith(("text/", "multipart/")) and "/" in main:
            continue
        way = fields.get("content-transfer-encoding", "").strip().lower()
        if way == "base64":
            body = _decode(_base64(body), _params(kind).get("charset")).replace("\r\n", "\n")
        elif way == "quoted-printable":
            raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
            body = _decode(raw, _params(kind).get("charset"))
        out.append(shown(body) if main == "text/html" else body)
    return out


def read_mail(text: str | None) -> tuple[str, list[str]]:
    """(subject, text parts in order). A null or empty mail has neither."""
    if not text:
        return "", []
    fields, body = _head(text.replace("\r\n", "\n"))
    return header_words(fields.get("subject", "")), _text_parts(fields, body)
