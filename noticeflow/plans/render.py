"""Reports as Markdown, HTML, JSON or by a template, and small SVG charts.

Only what a report shows comes to the driver: the rows of one page, ranked and limited.
"""

from __future__ import annotations

import html
import json
import math
import string
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from noticeflow.functions import rules
from noticeflow.operators import collect, digest

@dataclass
class Digest:
    """Counts that stand above a report: (name, n) each, and how many there are in all."""

    agencies: list[tuple[str, int]]
    categories: list[tuple[str, int]]
    keywords: list[tuple[str, int]]
    agency_total: int = 0
    category_total: int = 0

    @staticmethod
    def of(notices: DataFrame) -> Digest:
        """Three tops of a dozen rows at most, and one row of totals, come to the driver."""
        top = lambda df: [tuple(r) for r in df.collect()]
        whole = digest.totals(notices).head()
        return Digest(top(digest.agencies(notices)), top(digest.categories(notices)), top(digest.keywords(notices)), whole.distinct_agency, whole.distinct_category)


@dataclass
class Report:
    """Rows in report order, and what stands above them."""

    rows: list[dict]
    generated_at: str
    title: str = "공지 모음"
    failed: list[str] = field(default_factory=list)
    since_days: int | None = None
    digest: Digest | None = None

    @staticmethod
    def of(notices: DataFrame, generated_at: str, most: int = 1000, **more) -> Report:
        got = collect.ranked(notices, most).orderBy("rank").collect()
        return Report([r.asDict(True) for r in got], generated_at, **more)

    def groups(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for r in self.rows:
            out.setdefault(r["agency"], []).append(r)
        return dict(sorted(out.items()))


def _date(r: dict) -> str:
    return r["published"].isoformat() if r.get("published") else "날짜 미상"


def _tier(r: dict) -> str:
    t = (r.get("rights") or "").strip().lower()
    return t if t in rules.TIERS else "unknown"


def _cell(text: str | None) -> str:
    return (text or "").replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def digest_md(report: Report) -> str:
    if report.digest is None:
        return ""
    line = lambda pairs: ", ".join(f"{_cell(n)} {k}" for n, k in pairs)
    d = report.digest
    named = (("기관", d.agencies, d.agency_total), ("분류", d.categories, d.category_total), ("낱말", d.keywords, len(d.keywords)))
    return "\n".join(f"- {name}: {line(pairs)}" + (f" 외 {total - len(pairs)}" if total > len(pairs) else "") for name, pairs, total in named if pairs)


def body_md(report: Report) -> str:
    out = []
    for agency, rows in report.groups().items():
        out += ["", f"## {_cell(agency)} ({len(rows)})", "", "| 날짜 | 제목 | 이용 |", "|---|---|---|"]
        out += [f"| {_date(r)} | [{_cell(r['title'])}]({r['url']}) | {rules.TIER_BADGES[_tier(r)]} |" for r in rows]
    return "\n".join(out).strip("\n")


def tiers_present(report: Report) -> list[str]:
    there = {_tier(r) for r in report.rows}
    return [t for t in rules.TIERS if t in there]


def legend_md(report: Report) -> str:
    return "\n".join(f"- {rules.TIER_BADGES[t]}: {rules.TIER_LABELS[t]}" for t in tiers_present(report))


def markdown(report: Report) -> str:
    head = [f"# {report.title}", "", f"- {report.generated_at} · {len(report.rows)}건 · {len(report.groups())}개 기관"]
    head += [f"- 수집 실패: {x}" for x in report.failed]
    return "\n\n".join(x for x in ("\n".join(head), digest_md(report), body_md(report), legend_md(report)) if x) + "\n"


def _esc(text: str | None) -> str:
    return html.escape(text or "", quote=True)


def body_html(report: Report) -> str:
    out = []
    for agency, rows in report.groups().items():
        items = (f"<li>{_date(r)} <a href='{_esc(r['url'])}'>{_esc(r['title'])}</a> <small>{rules.TIER_BADGES[_tier(r)]}</small><p>{_esc(r.get('summary'))}</p></li>" for r in rows)
        out.append(f"<h2>{_esc(agency)} ({len(rows)})</h2><ul>{''.join(items)}</ul>")
    return "".join(out)


def _listed(lines: str) -> str:
    return "<ul>" + "".join(f"<li>{_esc(x.removeprefix('- '))}</li>" for x in lines.splitlines()) + "</ul>" if lines else ""


def page(report: Report) -> str:
    head = f"<!doctype html><meta charset='utf-8'><title>{_esc(report.title)}</title><h1>{_esc(report.title)}</h1><p>{_esc(report.generated_at)} · {len(report.rows)}</p>"
    return head + _listed(digest_md(report)) + body_html(report) + _listed(legend_md(report))


def _row(r: dict) -> dict:
    text = lambda k: r.get(k) or ""
    links = [{k: x[k] for k in ("label", "url", "kind")} for x in r.get("links") or []]
    day = r["published"].isoformat() if r.get("published") else None
    return {
        "title": text("title"), "url": text("url"), "agency": text("agency"), "published": day, "new": bool(r.get("is_new")), "topics": list(r.get("topics") or []), "org": text("org"), "site": text("site"),
        "unit": text("unit"), "origin": text("origin"), "links": links, "summary": text("summary"), "category": text("category"), "rights": _tier(r), "rights_label": rules.TIER_LABELS[_tier(r)],
    }


def as_json(report: Report) -> str:
    d = report.digest
    counts = d and {"agencies": d.agencies, "agency_total": d.agency_total, "category_total": d.category_total, "categories": d.categories, "keywords": d.keywords}
    new = sum(bool(r.get("is_new")) for r in report.rows)
    head = {"title": report.title, "generated_at": report.generated_at, "since_days": report.since_days, "count": len(report.rows), "new_count": new, "agencies": list(report.groups()), "failed_sources": report.failed}
    return json.dumps({**head, "digest": counts, "notices": [_row(r) for r in report.rows]}, ensure_ascii=False, indent=2)


def template(report: Report, text: str) -> str:
    """``$name`` marks of a template; unknown ones stay, and ``$$`` is a dollar."""
    marks = {
        "title": report.title, "generated_at": report.generated_at or "미상", "count": len(report.rows), "agency_count": len(report.groups()), "new_count": sum(bool(r.get("is_new")) for r in report.rows),
        "agencies": ", ".join(report.groups()), "since_days": "" if report.since_days is None else report.since_days, "failed_sources": ", ".join(report.failed), "body_md": body_md(report),
        "digest_md": digest_md(report), "legend_md": legend_md(report), "body_html": body_html(report), "digest_html": _listed(digest_md(report)), "legend_html": _listed(legend_md(report)),
    }
    return string.Template(text).safe_substitute(marks)


@dataclass
class Brief:
    """Issues of a theme in order: rows of ``insight.brief`` and what was looked at."""

    title: str
    issues: list[dict]
    considered: int = 0
    generated_at: str = ""

    def sections(self) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {}
        for r in sorted(self.issues, key=lambda r: (r["section_ord"], r["pos"])):
            out.setdefault(r["section"], []).append(r)
        return out


def brief(b: Brief, form: str) -> str:
    """A brief as Markdown, HTML or JSON; evidence is the first three matched words."""
    why = lambda r: ", ".join((r.get("matched") or [])[:3])
    if form == "json":
        sections = [{"name": n, "issues": [{"title": r["title"], "score": r["score"], "size": r["n"], "evidence": (r.get("matched") or [])[:3]} for r in rows]} for n, rows in b.sections().items()]
        return json.dumps({"title": b.title, "generated_at": b.generated_at, "considered": b.considered, "sections": sections}, ensure_ascii=False, indent=2)
    if form == "md":
        out = [f"# {b.title}", "", f"- {b.generated_at} · {len(b.issues)} / {b.considered}"]
        for name, rows in b.sections().items():
            out += ["", f"## {_cell(name)}", "", *(f"- {_cell(r['title'])} ({r['score']}점, {r['n']}건{'; ' + why(r) if why(r) else ''})" for r in rows)]
        return "\n".join(out) + "\n"
    if form == "html":
        parts = (f"<h2>{_esc(name)}</h2><ol>" + "".join(f"<li>{_esc(r['title'])} <small>{r['score']} · {r['n']} {_esc(why(r))}</small></li>" for r in rows) + "</ol>" for name, rows in b.sections().items())
        return f"<!doctype html><meta charset='utf-8'><title>{_esc(b.title)}</title><h1>{_esc(b.title)}</h1>" + "".join(parts)
    raise ValueError(f"unknown form: {form}")


def wide(text: str) -> int:
    """Columns that a text takes where full-width characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def access_table(verdicts: list[dict]) -> str:
    """Organisations with what is open, blocked ones first; names padded by their columns."""
    if not verdicts:
        return ""
    room = max(wide(r["org"]) for r in verdicts)
    rows = sorted(verdicts, key=lambda r: (r["verdict"] != "blocked", r["org"]))
    return "\n".join(f"{r['org']}{' ' * (room - wide(r['org']))}  {r['allowed']}/{r['paths']}  {rules.VERDICT_LABELS[r['verdict']]}" for r in rows)


def progress(done: int, total: int, elapsed: float) -> tuple[int, float]:
    """(whole percent, seconds left; -1 while nothing is done)."""
    return (100 * done // total if total else 0, elapsed / done * (total - done) if done else -1.0)


def draft_sources(entries: list[dict]) -> str:
    """Found sources as a registry file: each with its evidence, and whether it was verified."""
    rows = [{k: v for k, v in e.items() if not k.startswith("_")} | {"_evidence": e.get("_evidence", ""), "_verified": bool(e.get("_verified"))} for e in entries]
    return json.dumps({"sources": rows}, ensure_ascii=False, indent=2)


def render(report: Report, form: str) -> str:
    forms = {"md": markdown, "html": page, "json": as_json}
    if form not in forms:
        raise ValueError(f"unknown form: {form}")
    return forms[form](report)


def nice_max(v: float) -> float:
    """The least 1, 2 or 5 times a power of ten that is not below ``v``."""
    if v <= 0:
        return 1.0
    unit = 10 ** math.floor(math.log10(v))
    return next(k * unit for k in (1, 2, 5, 10) if v <= k * unit)


def bars(labels: list[str], values: list[int], width: int = 560, row: int = 24) -> str:
    """Horizontal bars."""
    top = nice_max(max(values, default=0))
    each = (
        f"<text x='0' y='{i * row + 16}'>{html.escape(n)}</text><rect x='140' y='{i * row + 4}' width='{(width - 200) * v / top:.1f}' height='{row - 8}'/><text x='{150 + (width - 200) * v / top:.1f}' y='{i * row + 16}'>{v}</text>"
        for i, (n, v) in enumerate(zip(labels, values, strict=True))
    )
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{row * len(labels)}'>{''.join(each)}</svg>"


def sparkline(values: list[int], width: int = 140, height: int = 30) -> str:
    top, step = max(max(values, default=0), 1), width / max(len(values) - 1, 1)
    points = " ".join(f"{i * step:.1f},{height - 2 - (height - 4) * v / top:.1f}" for i, v in enumerate(values))
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}'><polyline fill='none' stroke='currentColor' points='{points}'/></svg>"
