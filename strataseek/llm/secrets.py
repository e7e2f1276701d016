"""Literal secrets in source code, configuration and notes: found through encoded layers, redacted in place."""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import DataFrame

from strataseek.operators.dedup import distinct_by_key

MASK = "[REDACTED]"

# Shapes of tokens that providers document.
_PROVIDER = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:"
    r"(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}"
    r"|gh[pousr]_[A-Za-z0-9]{30,255}"
    r"|github_pat_[A-Za-z0-9_]{22,255}"
    r"|glpat-[A-Za-z0-9_-]{20,}"
    r"|AIza[A-Za-z0-9_-]{35}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{10,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|whsec_[A-Za-z0-9+/=]{16,}"
    r"|sk-(?:proj-|ant-|svcacct-)?[A-Za-z0-9_-]{20,}"
    r"|npm_[A-Za-z0-9]{36}"
    r"|pypi-[A-Za-z0-9_-]{32,}"
    r"|hf_[A-Za-z]{30,}"
    r"|do[opr]_v1_[a-f0-9]{64}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}"
    r"|ya29\.[A-Za-z0-9_-]{20,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r")(?![A-Za-z0-9+/])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"(?:\s|\\[nrt]|[\"'+,\\#*/>|]|(?:Proc-Type|DEK-Info|Comment|Version)[^\n\r]*)*[A-Za-z0-9+/=]{24,}")
_PUTTY = re.compile(r"PuTTY-User-Key-File-\d:[^\0]*?Private-Lines: *\d+\s+[A-Za-z0-9+/=]{16,}")
_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s/:@\"'`<>]*):([^\s/@\"'`<>]+)@[A-Za-z0-9_\[$%{]")
_USER_OPTION = re.compile(r"(?:(?<=\s)|^)(?:-u|--user)[ =]+[\"']?([^\s:\"']+):([^\s\"']+)")
_PASS_OPTION = re.compile(r"(?:sshpass +-p *|--password[ =]|mysql\b[^\n]*? -p)[\"']?([^\s\"']{4,})")
_AUTH = re.compile(r"(?i)\b(bearer|basic|token)\s+([A-Za-z0-9+/_.~=-]{16,})")

# Words that name a secret, in identifiers and in prose of five languages.
_CORES = ("pass", "pwd", "pw", "secret", "token", "bearer", "cred", "login", "auth", "key", "kennwort", "contrase")
_REST = re.compile(r"(?:word|wort|wd|phrase|code|w|ed|ential|na|ña)?s?(?:[_-]?(?:value|text|string|prod|dev|live|staging|main|default|\d{1,2}))?(?![A-Za-z0-9_-])")
_KEY_OF = re.compile(r"(?:api|access|private|secret|signing|encryption|auth|master|account|deploy)[_-]?$")
_PLURAL = re.compile(r"(?:tokens|keys|pw[sd]s)$")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
_VALUE = re.compile(
    r"[\"']?(?:\s*\]|\s*\))?(?:\s*:\s*(?:string|str|String|&str|const char ?\*))?\s*(?::=|=>|==?|:|\s(?=['\"]))\s*"
    r"([rbuf]?\"\"\"[^\"]*\"\"\"|[rbuRBU]?\"(?:[^\"\\\r\n]|\\.)*\"|[rbuRBU]?'(?:[^'\\\r\n]|\\.)*'|`[^`\r\n]*`|[^\s,;\"'`]+)"
)
_TALK = (
    "password", "passwort", "kennwort", "passphrase", "passcode", "mot de passe", "contrase", "clave", "secret", "token", "api key", "api-key", "api-schlüssel", "clé d'api",
    "log in", "login", "sign in", "anmelden", "einloggen", "connexion", "zugangsdaten", "credentials", "identifiants", "密码", "口令", "密钥", "令牌", "登录",
)
_TALK_VALUE = re.compile(r"(?:[:：/]|\b(?:is|was|lautet|ist|est|es|son|sont|use|type|enter|give|try|with|mit|avec|con|as|to|auf|à|gib|tippe|nimm|nutze|tape|tapez|saisir|saisissez|entrez|utilisez|escribe|escriba|introduce|teclea|usa|use)\b|是|为|输入|使用|用|,|，)\s*[\"'`“«(]?([^\s\"'`“”«»，。；,;]{6,})")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:(?:your|my|the|some|any|new|old|insert|enter|put|add|set|replace|example|sample|dummy|fake|test|demo|default|placeholder|change)[_\- .]?.*|"
    r"user(?:name)?|pass(?:word|wd|phrase)?|pwd|secret|token|key|api[_-]?key|host|port|value|string|none|null|nil|undefined|true|false|yes|no|todo|tbd|n/?a|redacted|removed|hidden|masked|empty|unset|required|optional|changeme|"
    r"x{3,}|\*+|\.{2,}|-+|_+|#+|•+|…+|\?+|0+|1234(?:5(?:6(?:7(?:8(?:9?0?)?)?)?)?)?|foo|bar|foobar|abc|abc123|qwerty)$"
)
_LOOKUP = re.compile(
    r"(?i)^(?:[$%@&!<{\[(*]|ref\+|vault:|secret(?:s|ref)?[:.]|env[:.(\[]|env$|arn:|ssm:|keyring|file:|/run/secrets|process\.env|os\.|config[.\[(]|settings[.\[]|self\.|this\.|ctx\.|args\.|opts?\.|params?\.|get[A-Za-z_]*\(|[A-Za-z_][\w.]*[(\[])|\$\{|\{\{|%\(|<[A-Za-z _-]+>|%[sdv](?![A-Za-z0-9])"
)
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_UPPER, _LOWER = re.compile(r"[A-Z]"), re.compile(r"[a-z]")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f]")
#: Stretches of readable bytes between others; shorter ones arise by chance.
_READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{16,}")
_TAIL = re.compile(r"(?:[ \t]*[\"'#/*>|+]*[ \t]*[A-Za-z0-9+/=]{1,80}[\"',+\\]*[ \t]*(?:\\n[\"',+]*)?(?:\r\n|\r|\n))+[ \t]*[\"'#/*>|+]*[ \t]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_HEX = re.compile(r"(?:0x|\\x)?[0-9A-Fa-f]{24,}")
_PERCENT = re.compile(r"(?:[A-Za-z0-9._~+*!-]*%[0-9A-Fa-f]{2})+[A-Za-z0-9._~+*!-]*")
_PERCENT_BYTE = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPED = re.compile(r"(?:[\x20-\x21\x23-\x26\x28-\x5b\x5d-\x5f\x61-\x7e]{0,64}(?:\\x[0-9A-Fa-f]{2}|\\u\{?[0-9A-Fa-f]{4}\}?|\\[0-7]{3}|&#x?[0-9A-Fa-f]{2,4};)){3,}[\x20-\x21\x23-\x26\x28-\x5b\x5d-\x5f\x61-\x7e]{0,64}")
_ESCAPE = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u\{?([0-9A-Fa-f]{4})\}?|\\([0-7]{3})|&#x([0-9A-Fa-f]{2,4});|&#(\d{2,4});")
_LINES = re.compile(r"\r\n|\r|\n")
_BLOCK = re.compile(r"(?:^[ \t]*[rb]?[\"']?[A-Za-z0-9+/]{40,}={0,2}[\"']?[,+\\]?[ \t]*(?:\r\n|\r|\n)){1,}[ \t]*[rb]?[\"']?[A-Za-z0-9+/]{4,}={0,2}[\"']?", re.M)
_PROSE_EXT = {"md", "mdx", "txt", "rst", "tex", "html", ""}
#: Languages in which a bare word after ``=`` or ``:`` is a value, not a name.
_DATA_EXT = {"yaml", "yml", "env", "ini", "cfg", "conf", "toml", "properties", "sh", "md", "mdx", "txt", "rst", "tex", "html", "json", ""}


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, n, p = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4 or p + k > end:
            return None
        n, p = int.from_bytes(data[p : p + k], "big"), p + k
    return (tag, p, p + n) if p + n <= end else None


def is_key_container(data: bytes) -> bool:
    """Whether bytes are a private key: PKCS#1, SEC1, PKCS#8 plain or encrypted, or the OpenSSH format."""
    if data.startswith(b"openssh-key-v1\0"):
        return True
    top = _der(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] < 0.9 * len(data) or len(data) < 32:
        return False
    parts, at = [], top[1]
    while at < top[2] and len(parts) < 12:
        e = _der(data, at, top[2])
        if not e:
            return False
        parts.append((e[0], data[e[1] : e[2]]))
        at = e[2]
    tags = [t for t, _ in parts]
    if tags[:1] == [0x02] and parts[0][1] in (b"\0", b"\1"):
        if len(parts) >= 9 and set(tags[:9]) == {0x02}:
            return True  # PKCS#1: version and eight integers
        if parts[0][1] == b"\1" and tags[1:2] == [0x04] and len(parts[1][1]) >= 16:
            return True  # SEC1
        return tags[1:3] == [0x30, 0x04]  # PKCS#8
    inner = _der(parts[0][1], 0, len(parts[0][1])) if tags == [0x30, 0x04] else None
    return bool(inner and inner[0] == 0x06 and bytes.fromhex("2a864886f70d0105") in parts[0][1])  # encrypted PKCS#8


def _classes(v: str) -> int:
    return sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s_.\-/]"))


def _literal(v: str, ext: str, name: str) -> str | None:
    """The secret in the value of an assignment, or None for placeholders, look-ups and plain words."""
    m = re.match(r"[rbuf]?(\"\"\"|[\"'`])", v, re.I)
    quoted = bool(m)
    if m:
        v = v[m.end() : -len(m.group(1))] if v.endswith(m.group(1)) else v[m.end() :]
    else:
        v = v.rstrip(".,;)]}")
    if len(v) < 6 or re.search(r"\s", v.strip()) or _PLACEHOLDER.match(v) or _LOOKUP.search(v):
        return None
    if re.fullmatch(r"[*xX.•\-_#]+.{0,4}|.{0,4}[*•]{3,}.{0,4}", v) or len(set(v)) < 4:
        return None
    if not quoted and (ext not in _DATA_EXT or re.fullmatch(r"[A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)+", v)) and not re.search(r"\d", v):
        return None
    if "://" in v or re.fullmatch(r"(?:\.{0,2}/)?[\w.-]+(?:/[\w.-]+)*\.[a-z]{1,5}", v) or re.fullmatch(r"\d+(?:\.\d+)*[a-z]{0,2}", v):
        return None
    strong = re.search(r"(?i)pass|pwd|^pw$|[_-]pw$|secret|cred|kennwort|contrase", name)
    k = _classes(v)
    if k >= 2 or (k == 1 and len(v) >= 20 and len(set(v)) >= 10 and re.search(r"\d", v)):
        # words joined by - or _ with one capital, or plain identifiers, are names rather than secrets
        if re.fullmatch(r"[A-Z][a-z]+|[a-z]+(?:[A-Z][a-z]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", v) and not (strong and quoted):
            return None
        return v
    return v if strong and quoted and len(v) >= 8 and not re.fullmatch(r"[a-z]+(?:[-_ .][a-z]+)*", v) else None


def _spoken(v: str) -> str | None:
    """The secret in running text: only what no word of a language looks like."""
    v = v.rstrip(".,;:!?)]}>»”'\"*_~`").lstrip("*_~`(<[{")
    if len(v) < 8 or _PLACEHOLDER.match(v) or _LOOKUP.search(v) or "://" in v or v.count("/") > 1 or not re.fullmatch(r"[!-~]+", v):
        return None
    digits, symbols = len(re.findall(r"\d", v)), len(re.findall(r"[^A-Za-z0-9]", v))
    if re.search(r"=(?!=*$)|[|(){}<>\[\]]|&[a-z]+$", v):
        return None
    if re.fullmatch(r"[\w.-]+\.(?:[a-z]{2,4})|[\d.,:/%-]+|v?\d+(?:\.\d+)+|[a-z_]+\(.*", v) or re.fullmatch(r"[A-Za-z]+(?:-[A-Za-z]+)*", v) and not re.search(r"[a-z][A-Z]", v):
        return None
    mixed = bool(re.search(r"[a-z]", v)) and bool(re.search(r"[A-Z]", v))
    return v if (digits and (mixed or symbols or len(v) >= 16)) or (symbols and _classes(v) >= 2 and re.search(r"[!#$%&*+@^~]", v)) or (mixed and len(v) >= 12) else None


def _plain(text: str, ext: str) -> list[tuple[int, int, str]]:
    """Secrets written as they are: (start, end, kind)."""
    low = text.lower()
    if len(low) != len(text):  # some letters grow when lower-cased; offsets must stay
        low = "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))
    out: list[tuple[int, int, str]] = []
    if "private key" in low:
        for m in _PEM.finditer(text):
            body = _PEM_BODY.match(text, m.end())
            if body:
                stop = _PEM_END.search(text, m.end())
                nxt = _PEM.search(text, m.end())
                if stop and (not nxt or stop.end() <= nxt.start()):
                    out.append((m.start(), stop.end(), "private_key"))
                else:
                    rest = re.compile(r"(?:[A-Za-z0-9+/=]{4,}|\s|\\[nrt])+").match(text, body.end())
                    out.append((m.start(), rest.end() if rest else body.end(), "private_key"))
    if "putty-user-key" in low:
        out += [(m.start(), m.end(), "private_key") for m in _PUTTY.finditer(text)]
    out += [(m.start(), m.end(), "token") for m in _PROVIDER.finditer(text) if len(set(m.group(0))) > 8 and "EXAMPLE" not in m.group(0)]
    if "://" in text and "@" in text:
        for m in _URL.finditer(text):
            v = m.group(2)
            if not _PLACEHOLDER.match(v) and not _LOOKUP.search(v) and len(v) > 2 and not (v.isupper() and v.isalpha()):
                out.append((m.start(2), m.end(2), "url_login"))
    if "-u" in low or "--user" in low:
        for m in _USER_OPTION.finditer(text):
            v = m.group(2)
            if not _PLACEHOLDER.match(v) and not _LOOKUP.search(v) and len(v) > 3 and not (v.isupper() and v.isalpha()):
                out.append((m.start(2), m.end(2), "command_login"))
    if "sshpass" in low or "--password" in low or "mysql" in low:
        for m in _PASS_OPTION.finditer(text):
            if _literal(f'"{m.group(1)}"', "sh", "password"):
                out.append((m.start(1), m.end(1), "command_login"))
    if "bearer " in low or "basic " in low:
        for m in _AUTH.finditer(text):
            v = m.group(2)
            if re.search(r"\d", v) and _classes(v) >= 3 and not _PLACEHOLDER.match(v):
                ok = m.group(1).lower() != "basic"
                if not ok:
                    try:
                        ok = b":" in base64.b64decode(v + "=" * (-len(v) % 4))
                    except (binascii.Error, ValueError):
                        ok = False
                if ok:
                    out.append((m.start(2), m.end(2), "token"))
    for core in _CORES:
        at = low.find(core)
        begin = known = 0  # the name that ends at ``known`` begins at ``begin``
        while at >= 0:
            rest = _REST.match(low, at + len(core))
            m = rest and _VALUE.match(text, rest.end())
            if m:
                i = at
                while i > known and text[i - 1] in _NAME:
                    i -= 1
                begin, known = (begin if i == known and known else i), at
                before = text[begin:at]
                name = before + text[at : rest.end()]
                if re.match(r"[A-Za-z_]", name) and "public" not in name.lower() and not _PLURAL.search(name.lower()) and (core != "key" or _KEY_OF.search(before.lower())):
                    v = _literal(m.group(1), ext, name)
                    if v:
                        x = text.index(v, m.start(1))
                        out.append((x, x + len(v), "assignment"))
            at = low.find(core, at + len(core))
    if ext in _PROSE_EXT or "#" in text or "//" in text or "--" in text:
        for word in _TALK:
            at = low.find(word)
            while at >= 0:
                end = at + len(word)
                if not (word.isascii() and (re.match(r"\w", low[at - 1 : at]) or word != "contrase" and re.match(r"\w", low[end : end + 1]))):
                    eol = _LINES.search(text, end)
                    # what follows the next mention is looked at from there
                    again = low.find(word, end)
                    stop = min(eol.start() if eol else len(text), again if again >= 0 else len(text))
                    for x in _TALK_VALUE.finditer(text, end, stop):
                        v = _spoken(x.group(1))
                        if v:
                            x = text.index(v, x.start(1))
                            out.append((x, x + len(v), "spoken"))
                at = low.find(word, end)
    return out


def _decodings(text: str) -> Iterator[tuple[int, int, bytes, int]]:
    """Encoded literals of a text as (start, end, what they decode to, characters for three bytes).

    The last is 4 for base64, whose parts can be told, 0 for literals that
    stand or fall as a whole. Signs of base64 are also signs of paths and
    names, so a run may begin before the literal does: each of its four
    alignments is decoded.
    """
    longest = 0
    for m in _RUN.finditer(text):
        body = m.group(0).rstrip("=")
        longest = max(longest, len(body))
        if not _UPPER.search(body) or not _LOWER.search(body):
            continue
        alt = b"-_" if "-" in body or "_" in body else None
        for shift in range(4):
            part = body[shift:]
            if len(part) % 4 == 1:
                part = part[:-1]
            try:
                yield m.start() + shift, m.end(), base64.b64decode(part + "=" * (-len(part) % 4), altchars=alt), 4
            except (binascii.Error, ValueError):
                break
    for m in _HEX.finditer(text):
        s = m.group(0).removeprefix("0x").removeprefix("\\x")
        if len(s) % 2 == 0:
            yield m.start(), m.end(), bytes.fromhex(s), 0
    if "%" in text and _PERCENT_BYTE.search(text):
        for m in _PERCENT.finditer(text):
            yield m.start(), m.end(), unquote_to_bytes(m.group(0)), 0
    if len(_ESCAPE.findall(text)) > 2:
        for m in _ESCAPED.finditer(text):
            s = _ESCAPE.sub(lambda x: chr(int(x[1] or x[2] or x[4], 16) if x[1] or x[2] or x[4] else int(x[3], 8) if x[3] else int(x[5])), m.group(0))
            yield m.start(), m.end(), s.encode("utf-8", "surrogatepass"), 0
    for m in _BLOCK.finditer(text) if longest >= 40 else ():
        joined = re.sub(r"[^A-Za-z0-9+/]", "", re.sub(r"(?m)^[ \t]*[rb]?[\"']?|[\"',+\\ \t]+$", "", m.group(0)))
        try:
            yield m.start(), m.end(), base64.b64decode(joined[: len(joined) // 4 * 4]), 0
        except (binascii.Error, ValueError):
            pass


def _texts(data: bytes) -> Iterator[tuple[int, int, str]]:
    """What can be read in decoded bytes: all of it where it is text, else its readable stretches, with their place."""
    try:
        inner = data.decode("utf-8")
        if not _CONTROL.search(inner):
            yield 0, len(data), inner
            return
    except UnicodeDecodeError:
        pass
    for m in _READABLE.finditer(data):
        inner = m.group(0).decode("ascii")
        if len(inner) >= 20 or sum(map(str.isalnum, inner)) * 10 >= len(inner) * 7:  # chance does not prefer letters
            yield m.start(), m.end(), inner


def find_secrets(text: str, ext: str = "") -> list[tuple[int, int, str]]:
    """Secrets of a text as disjoint (start, end, kind) in order; ``ext`` is the extension of its file.

    Encoded literals are decoded, layer by layer as long as that gives text,
    and searched again; a key container among them counts by its binary
    grammar. A secret inside an encoded literal is reported as that literal,
    or as its part from the first to the last readable byte where what
    surrounds it is not text.
    """
    spans = _plain(text, ext)
    for a, b, data, unit in _decodings(text):
        if is_key_container(data):
            spans.append((a, b, "private_key"))
            continue
        for p, q, inner in _texts(data):
            if len(inner) < b - a and find_secrets(inner, ""):
                part = unit and (p > 0 or q < len(data))
                spans.append((a + p // 3 * unit, min(b, a + -(-q // 3) * unit), "encoded") if part else (a, b, "encoded"))
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        if out and a < out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b, out[-1][2])
        else:
            out.append((a, b, kind))
    return out


def key_tail(text: str) -> int:
    """End of a private key whose beginning stands in the chunk before: key lines from the start on, and the end mark."""
    m = _TAIL.match(text)
    return m.end() if m else 0


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced; line ends inside a span stay, so lines keep their numbers."""
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], MASK, *_LINES.findall(text[a:b])]
        at = b
    return "".join([*out, text[at:]])


def _extension(path: object) -> str:
    name = re.split(r"[\\/]", path)[-1] if isinstance(path, str) else ""
    return name.rpartition(".")[2].lower() if "." in name else ""


def _searched(chunks: DataFrame) -> DataFrame:
    return chunks.where("content IS NOT NULL AND content <> ''").select("id", "rel_path", "content")


def scan_chunks(chunks: DataFrame) -> DataFrame:
    """Secrets of chunks: chunk_id, line_no (from 1 in the chunk), kind, char_start, char_end.

    ``chunks``: id, rel_path, content. Every content is searched whole,
    whatever its path says. Rows without content, and contents without a
    secret, give no rows; repeated rows give theirs again; other columns are
    ignored.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, path, text in zip(pdf["id"], pdf["rel_path"], pdf["content"], strict=True):
                spans = find_secrets(text, _extension(path))
                if spans:
                    ends = [m.end() for m in _LINES.finditer(text)]
                    rows += [(key, bisect_right(ends, a) + 1, kind, a, b) for a, b, kind in spans]
            yield pd.DataFrame(rows, columns=["chunk_id", "line_no", "kind", "char_start", "char_end"])

    return _searched(chunks).mapInPandas(scan, f"chunk_id {dict(chunks.dtypes)['id']}, line_no long, kind string, char_start long, char_end long")


def secret_lines(chunks: DataFrame) -> DataFrame:
    """chunk_id and line_no of lines that hold a secret, each once."""
    return scan_chunks(chunks).select("chunk_id", "line_no").distinct()


def redacted(chunks: DataFrame) -> DataFrame:
    """chunk_id, content (redacted), n_secrets of the chunks with secrets; repeated rows count once.

    The rest of a private key that begins in the chunk before is redacted too,
    though it is no line of ``secret_lines``.
    """

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, path, text in zip(pdf["id"], pdf["rel_path"], pdf["content"], strict=True):
                spans = find_secrets(text, _extension(path))
                tail = key_tail(text)
                if tail:
                    spans = [(0, tail, "private_key"), *(x for x in spans if x[0] >= tail)]
                if spans:
                    rows.append((key, redact(text, spans), len(spans)))
            yield pd.DataFrame(rows, columns=["chunk_id", "content", "n_secrets"])

    rows = distinct_by_key(_searched(chunks), "id")
    return rows.mapInPandas(clean, f"chunk_id {dict(chunks.dtypes)['id']}, content string, n_secrets long")
