"""Files that posts link to: what an address or a label says of them, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticeflow.functions import text as T
from noticeflow.functions import urls as U

# Endings and their kinds, words of addresses and labels, and what labels carry
# besides a name.
KINDS = {
    ".pdf": "PDF", ".hwp": "HWP", ".hwpx": "HWP", ".doc": "DOC", ".docx": "DOC", ".xls": "XLS", ".xlsx": "XLS", ".ppt": "PPT", ".pptx": "PPT",
    ".zip": "ZIP", ".csv": "CSV",
}
URL_HINTS = ("download", "filedown", "file_down", "fileid", "atchfile", "filesn", "file_sn", "getfile", "attach")
VIEW_HINTS = ("미리보기", "바로보기", "뷰어", "preview", "viewer")
ALL_FILES = ("일괄", "전체", "모두", "일괄받기", "전체받기", "전체파일", "첨부일괄")
ALL_FILES_LABEL = "첨부 모두 받기"
LABEL_TAIL = (
    r"(?i)(?:\s*(?:\(\s*새\s*창\s*(?:으로\s*)?(?:열림)?\s*\)|새\s*창\s*(?:으로\s*)?열림|"
    r"다운로드|내려받기|바로\s*보기|미리\s*보기|download))+\s*$"
)
WINDOW_HEAD = r"^\s*새\s*창\s*(?:으로\s*)?열림\s*"
BROKEN_NAME = r"^[?\x{FFFD}_\s.\-]*\.[A-Za-z0-9]{2,5}$"
GENERIC = (
    r"(?i)^(?:[\s()\[\]·:|/-]|새\s*창|열림|열기|이동|알림|문서|뷰어|바로|미리|보기|다운로드|내려받기|"
    r"받기|파일|첨부|download|view(?:er)?|preview|open)*$"
)
SIZE_TAIL = (
    r"(?i)\s*(?:[\[(]\s*\d[\d.,]*\s*(?:bytes?|[kmg]i?b?|바이트)\s*[\])]|"
    r"\d[\d.,]*\s*(?:bytes?|[kmg]i?b|바이트))\s*$"
)
LABEL_HEAD = (
    r"(?i)^(?:(?:첨부\s*파일|첨부|붙임|파일)\s*[:：]?\s+|"
    r"(?:pdf|hwpx?|docx?|xlsx?|pptx?|zip|jpe?g|png|gif)\s*(?:문서|파일)\s+)"
)
NAME_PARAMS = ("filenameorg", "orgfilename", "orignlfilenm", "orifilename", "origfilename", "realname", "filename", "file_name", "filenm", "atchfilenm", "fname", "fn", "name")
DOWNLOAD_QUERY = r"(?i)(?:^|&)(?:mode|act|cmd|type|method)=(?:download|down|filedown)(?:&|$)"
INVISIBLE = "[​-‍⁠﻿]"
LONGEST = 80

_ENDS = "(?:" + "|".join(e.lstrip(".") for e in KINDS) + "|jpe?g|png|gif)"
IMAGE = r"(?i)\.(?:jpe?g|png|gif|bmp|webp)$"


def _last(url: Column) -> Column:
    return F.element_at(F.split(T.path(url), "/"), -1)


def looks_like_file(url: Column) -> Column:
    """An address that gives a file at once, and no page."""
    last = F.lower(_last(url))
    ends = F.lit(False)
    for ext in KINDS:
        ends = ends | last.endswith(ext)
    return ends | last.rlike(IMAGE) | T.contains_any(last, ("download", "filedown", "getfile")) | U.query(url).rlike(DOWNLOAD_QUERY)


def kind(url: Column, label: Column) -> Column:
    """The kind of file by address and label; empty if it seems to be none."""
    path, low = F.lower(T.path(url)), F.lower(label)
    both = F.lower(F.concat_ws(" ", url, label))
    hinted = T.contains_any(F.concat(path, F.lit("?"), F.lower(U.query(url))), URL_HINTS) & ((U.query(url) != "") | _last(url).contains("."))
    out = F.when(path.rlike(IMAGE) | low.rlike(IMAGE), "그림").when(T.contains_any(both, VIEW_HINTS), "보기").when(hinted, F.when(F.lower(_last(url)).contains("zip"), "ZIP").otherwise("파일")).otherwise("")
    for ext, name in reversed(KINDS.items()):
        out = F.when(path.endswith(ext) | low.endswith(ext), name).otherwise(out)
    return out


def name_in(url: Column) -> Column:
    """A file's name in an address: of a parameter that holds one, else the end of the path."""
    ending = rf"(?i)\.{_ENDS}\b"
    pairs = F.transform(F.split(U.query(url), "&"), lambda p: F.struct(F.lower(F.element_at(F.split(p, "=", 2), 1)).alias("k"), F.trim(F.coalesce(F.try_url_decode(F.element_at(F.split(F.concat(p, F.lit("=")), "=", 3), 2)), F.lit(""))).alias("v")))
    named = F.filter(F.transform(pairs, lambda p: F.struct(F.array_position(F.array(*map(F.lit, NAME_PARAMS)), p["k"]).alias("at"), p["v"].alias("v"))), lambda p: (p["at"] > 0) & p["v"].rlike(ending))
    last = F.coalesce(F.try_url_decode(F.replace(_last(url), F.lit("+"), F.lit("%2B"))), F.lit(""))
    return F.coalesce(F.array_min(named)["v"], F.when(last.rlike(ending), last), F.lit(""))


def is_generic(label: Column) -> Column:
    return label.rlike(GENERIC)


def clean_label(c: Column) -> Column:
    """A label's name: what follows the last ending, sizes, buttons and heads are cut off."""
    t = T.squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, ""))
    upto = F.regexp_extract(t, rf"(?i)^(.+\.{_ENDS})\b", 1)
    t = F.when(upto != "", upto).otherwise(t)
    for _ in range(3):
        t = F.trim(F.regexp_replace(F.regexp_replace(t, LABEL_TAIL, ""), SIZE_TAIL, ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, WINDOW_HEAD, ""), LABEL_HEAD, ""))
    return F.when(t.rlike(BROKEN_NAME), "").otherwise(t)


def label(text: Column, title: Column, url: Column) -> Column:
    """The link's own label if it names something, else its title, else the address's name."""
    own, other, name = clean_label(text), clean_label(title), clean_label(name_in(url))
    every = F.replace(own, F.lit(" "), F.lit("")).isin(*ALL_FILES)
    first = F.when(~is_generic(own), own).when(~is_generic(other), other).when(~is_generic(name), name).otherwise("")
    return F.when(every, ALL_FILES_LABEL).otherwise(shorten(first))


def shorten(c: Column, longest: int = LONGEST) -> Column:
    """At most ``longest`` characters, with an ellipsis before the ending."""
    ending = F.regexp_extract(c, r"(\.[A-Za-z0-9]{2,5})$", 1)
    return F.when(F.length(c) > longest, F.concat(F.rtrim(F.substring(c, F.lit(1), F.lit(longest - 1) - F.length(ending))), F.lit("…"), ending)).otherwise(c)
