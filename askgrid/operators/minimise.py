"""Text minimisation: drop machine lines, redact identities, keep the wording."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from askgrid.functions.unicode import nfkc, normalized

# A line matching any of these is dropped.
DROPPED_LINES = (
    r"(?i)\[(?:api-inputs|username|api|position)\]\s*:",
    r"(?i)(?:access[_ -]?token|refresh[_ -]?token|authorization|password|\bPWD\s*=|\bAcUHO\b|cookie"
    r"|session[_ -]?id|api[_ -]?key)",
    r"(?i)Error occurred in ['\"]?(?:CLIENT|SERVER)|SQL Error:\s*Check API Log Report|Error Id:\s*\d+"
    r"|message:\s*(?:undefined|null)",
    r"(?i)^message\s*:?$",
    r"^(?:Traceback|at\s+[A-Za-z0-9_.<>]+\(|System\.[A-Za-z].*Exception|HTTP/[0-9]"
    r"|[A-Z][A-Za-z]+Exception:)",
    r"^(?:نام کاربر|نام و نام خانوادگی|نام درخواست کننده|موقعیت سازمانی|شماره همراه|شماره تماس|ایمیل)\s*:",
)

# Long lines that look like serialised payloads.
PAYLOAD_LENGTH = 250
PAYLOAD_STARTS = ("{", "[", '"')
PAYLOAD_RUN = r"[A-Za-z0-9+/=]{40,}"

# Replacements, applied in this order.
REPLACEMENTS = (
    (r"(?i)https?://\S+", "[removed URL]"),
    (r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b", "[removed email]"),
    (r"(?<!\d)09\d{9}(?!\d)", "[removed phone]"),
    (r"(?:آقای|اقای|خانم)\s+[؀-ۿA-Za-z.]+(?:\s+[؀-ۿA-Za-z.]+)?", "[removed person]"),
    (r"(?i)\b(?:bearer\s+)?[A-Za-z0-9+/=_-]{48,}\b", "[removed encoded value]"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
     "[removed diagnostic id]"),
    (r"(?i)(?:System\.)?[A-Za-z0-9_.]+Exception\s*:?\s*", ""),
    (r"(?i)Exception has been thrown by the target of an invocation\.?", ""),
    (r"(?i)Object reference not set to an instance of an object\.?", ""),
    (r"(?i)Sequence contains no (?:elements|matching element)\.?", ""),
    (r"(?i)Invalid object name\s+[\[\]A-Za-z0-9_.]+\.?", ""),
    (r"(?i)Could not use view or function\s+[\[\]A-Za-z0-9_.]+[^\n]*", ""),
    (r"(?i)Resolution\s*:\s*[^\n]*", ""),
    (r"از وقفه\s*[یي]\s*ایجاد شده پوزش می\s*طلبیم!?\s*لطفا با نگهدارنده\s*[یي]\s*سیستم تماس بگیرید\.?", ""),
    (r"خطای پایگاه داده!?\s*لطفا با نگهدارنده\s*[یي]\s*سیستم تماس بگیرید\.?", ""),
    (r"خطای پایگاه داده رخ داده است\.?\s*", ""),
    (r"اتصال به سرور با پایان مهلت زمانی مواجه شد\.?\s*", ""),
    (r"(?i)The object invoked has disconnected from its clients\.?", ""),
    (r"(?i)The wait operation timed out\.?", ""),
    (r"(?i)Resolution of the dependency failed[^؀-ۿ]*", ""),
    (r"(?i)Calling constructor[^؀-ۿ]*", ""),
    (r"(?i)Value cannot be null\.?\s*(?:\(Parameter\s+[^)]*\))?", ""),
    (r"(?i)Exception of type\s*['\"]*[^'\"]*['\"]*\s+was thrown\.?", ""),
    (r"(?i)Master Calculation\s*", ""),
    (r"(?i)\((?:Exception from HRESULT|Number)\s*[-:]?[^)]*\)", ""),
    (r"(?:شماره(?:\s+ی)?\s+خطا|کد\s+خطا)\s*[:：]?\s*(?:\[removed diagnostic id\]|\d+)?", ""),
    (r"(?i)\b(?:مدیر|کارشناس|سرپرست)\s+[؀-ۿ\s]{0,24}\s+[A-Z][a-z]{2,}\b", "[removed person]"),
    (r"(?i)\b(?:مدیر|کارشناس|سرپرست)\s+[؀-ۿ]+\s+[A-Z][A-Za-z.-]{2,}\b", "[removed person]"),
    (r"(?i)(?:مدیر|کارشناس|سرپرست)(?:\s+[؀-ۿA-Za-z]+){0,3}\s+[A-Z][A-Za-z.-]{2,}",
     "[removed person]"),
    (r"(?i)(?:مدیر\s+مالی|کارشناس\s+IT\s+تهران)\s+[A-Za-z.-]+", "[removed person]"),
    (r"(?i)[\(（]\s*(?:شناسه|ID)\s*[:：]\s*\d+\s*[\)）]", ""),
    (r"(?i)\b(?:شناسه|ID)\s*[:：]\s*\d+\b", "[removed record id]"),
    (r"\.{4,}", " "),
    (r"[ \t]{2,}", " "),
)

# Line breaks, and characters trimmed from the ends of a line.
LINE_BREAKS = r"[\n\x0B\x0C\x1C\x1D\x1E\x85  ]"
TRIMMED = " \\-:،؛"

# A field that matches is withheld as a whole.
SECRET = (r"(?i)(?:password|pwd|uid|user\s*id|username|connection\s*string|access[_ -]?token"
          r"|api[_ -]?key|authorization|server|data\s+source)\s*[:=]"
          r"|(?:postgres(?:ql)?|mssql|mysql)://|\bBearer\s+\S+")
WITHHELD = "[REDACTED_SENSITIVE_TEXT]"

UNICODE = "(?U)"

# Literal words, in lower case, without which no replacement above can match.
# Most lines hold none of them and skip the long pattern list.
REPLACE_HINTS = ("http", "@", "09", "exception", "object", "sequence contains", "could not use",
                 "resolution", "wait operation", "calling constructor", "value cannot",
                 "master calculation", "(number", ":", "：", "-", "....", "  ", "\t")
REPLACE_SHAPES = r"[؀-ۿ]|[A-Za-z0-9+/=_-]{48}"
BLANK = "\u0000"


def _any(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _dropped(line: Column) -> Column:
    matches = _any(line.rlike(UNICODE + pattern) for pattern in DROPPED_LINES)
    escapes = (F.length(line) - F.length(F.replace(line, F.lit('\\"'), F.lit("")))) / 2
    payload = (F.length(line) > PAYLOAD_LENGTH) & (
        _any(line.startswith(start) for start in PAYLOAD_STARTS) | (escapes > 3)
        | line.rlike(PAYLOAD_RUN))
    return matches | payload


def _redacted(line: Column) -> Column:
    cleaned = line
    for pattern, replacement in REPLACEMENTS:
        cleaned = F.regexp_replace(cleaned, UNICODE + pattern, replacement)
    hinted = _any(F.lower(line).contains(hint) for hint in REPLACE_HINTS) | line.rlike(REPLACE_SHAPES)
    return F.when(hinted, cleaned).otherwise(line)


def minimise(value: Column) -> Column:
    """Business wording of a text; blank runs become one blank line.

    One array step per stage, so that no stage is evaluated more than once.
    """
    unified = F.regexp_replace(nfkc(value), "\r\n|\r", "\n")
    stripped = F.transform(F.split(unified, LINE_BREAKS),
                           lambda line: F.regexp_replace(line, UNICODE + r"^\s+|\s+$", ""))
    kept = F.filter(stripped, lambda line: (line == "") | ~_dropped(line))
    marked = F.transform(kept, lambda line: F.when(line == "", F.lit(BLANK)).otherwise(
        F.regexp_replace(_redacted(line), f"^[{TRIMMED}]+|[{TRIMMED}]+$", "")))
    lines = F.transform(F.filter(marked, lambda line: line != ""),
                        lambda line: F.when(line == BLANK, F.lit("")).otherwise(line))
    joined = F.array_join(lines, "\n")
    return F.regexp_replace(F.regexp_replace(joined, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


# Machine messages inside a description, and titles that say nothing by themselves.
MACHINE_MESSAGE = (r"(?i)\bmessage:\s*(?:Object must implement IConvertible\.?"
                   r"|String .*? valid (?:TimeSpan|DateTime)\.?|undefined|null)\s*")
GENERIC_TITLE = r"(?i)^(?:فرم|گزارش)\s+[^:：]+[:：]?$"


def business_text(title: Column, description: Column) -> Column:
    """Title and description without machine messages; empty if nothing of the case's own is left."""
    named = normalized(title)
    wording = normalized(F.regexp_replace(normalized(description), UNICODE + MACHINE_MESSAGE, " "))
    return F.when(named.rlike(UNICODE + GENERIC_TITLE) & (wording == ""), F.lit("")).otherwise(
        F.trim(F.concat_ws(" ", named, wording)))


def redact_secrets(value: Column) -> Column:
    """Withhold a whole field that contains a credential."""
    return F.when(value.rlike(SECRET), F.lit(WITHHELD)).otherwise(value)
