"""SQL for DuckDB with the same rows as the queries of the catalog."""

from __future__ import annotations

import unicodedata

from noticeflow.functions import korean, rules
from noticeflow.plans.views import LABELS, NOTICES_SQL, ORDERS_SQL

NOW, DAYS = "2024-06-30", 180
DATES = (
    "2024-03-05", "2024.3.5 10:00", "20240305", "2024년 3월 5일", "24.03.05", "2024-13-40 24.03.05", "no date", "2024/12/31", "Tue, 05 Mar 2024 10:00:00 +0900", "5 Foo 2024",
    "2024. 3. 5.", "99.12.31", "24.13.05", "20241305", "2024-02-30", "24-3-5", "2024년3월 5일", "120240305",
)
DATE_HEADS = ("", "등록일 ", "(", "게시", "x", "9", " ")
DATE_TAILS = ("", ")", " 24.01.02", "호", "1", " 마감")
LABEL_CORES = ("공지사항", "학사", "READ", "더보기", "장학 안내", "그림자의+밤", "리더", "취업게시판", "")
LABEL_HEADS = ("", "- ", "· ", "+ ", "전체 ", "▶more ")
LABEL_TAILS = ("", " 더보기", "목록", "(목록)", " 게시판", " more", "+", " 바로 가기", "more", " 더", " 2024학년도")
TITLE_HEADS = ("", "[국립도서관] 새글 ", "새글 ", "첨부파일 있음 열기 ", "공지 [기획팀] ", "[a] ")
TITLE_TAILS = ("", "새글", "첨부파일이 1개 있음", "새글 첨부파일 있음", "조회수 109", "총무팀 조회 37", "등록일 2026.10.08 조회 3", "비밀글입니다", "https://a-very-long-address.example.kr/x/y/z", "N")
SLOT_LABELS = ("공지사항", "장학공지", "입학", "채용", "컴퓨터학과 공지", "자료실", "대학원 공지", "Q&A", "2027년도 장학", "학사 일정", "장학 서식")
FILE_TAILS = ("", "/a.hwp", "/download.do?fileNo=3", "/x.PNG", "/view.do?preview=1", "/zipDown.do?atchFileId=1", "/support/download", "/press.do?mode=down")
FILE_LABELS = ("다운로드", "공고문.pdf (12KB) 다운로드", "", "첨부파일: 자료집 [1.2MB] 미리보기", "사진.jpg 바로보기")


def _letters(word: str, spoken: bool) -> str:
    """A word in Latin letters by its decomposed form, whose parts are code points in order."""
    out = ""
    for c in unicodedata.normalize("NFD", word):
        at = ord(c)
        if 0x1100 <= at < 0x1113:
            out += korean.INITIALS[at - 0x1100]
        elif 0x1161 <= at < 0x1176:
            out += korean.VOWELS[at - 0x1161]
        elif 0x11A8 <= at < 0x11C3:
            out += (korean.SPOKEN if spoken else korean.FINALS)[at - 0x11A7]
        elif c.isalnum():
            out += c.lower()
    return out


def aliases(word: str) -> list[str]:
    found = set()
    for spoken in (False, True):
        if len(_letters(word, spoken)) >= 3:
            found.add(_letters(word, spoken))
            if len(word) > 1 and len(_letters(word[:2], spoken)) >= 4:
                found.add(_letters(word[:2], spoken))
    return sorted(found)


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_s, values)) + "]"


def fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


def _first(c: str, table) -> str:
    low = f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    cases = " ".join("WHEN " + " OR ".join(f"contains({low}, {_s(w)})" for w in words) + f" THEN {_s(name)}" for name, words in table)
    return f"(CASE {cases} ELSE '' END)"


def classify(c: str) -> str:
    return _first(c, rules.CATEGORY_HINTS)


def canonical(c: str) -> str:
    return f"coalesce(nullif({classify(c)}, ''), '{rules.OTHER}')"


NAME = f"(CASE WHEN trim(category) = '' THEN '{rules.UNSORTED}' ELSE {canonical('category')} END)"
STEM = f"'^(.{{2,}}?)(?:{'|'.join(rules.SUFFIXES)})$', '\\1'"
TOPICAL = f"length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$') AND {fold('t')} NOT IN ({', '.join(map(_s, rules.STOPWORDS))}) AND NOT regexp_matches(t, {_s(rules.ORDINAL)})"
KEY = f"{fold('trim(url)')}"
SINCE = f"(published IS NULL OR published >= DATE '{NOW}' - {DAYS})"
CURRENT = f"""{NOTICES_SQL}, c AS (
    SELECT * FROM n WHERE {SINCE} QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY src_idx, item_idx) = 1
)"""
SEEN = f"seen AS (SELECT {KEY} AS key, min(item_idx) AS pos FROM n WHERE item_idx % 3 <> 0 GROUP BY 1)"
DERIVATIVE = "lower(trim(rights)) IN ('public_domain', 'kogl_type1', 'kogl_type2')"


def _score(forms) -> str:
    def any_in(c):
        return "(" + " OR ".join(f"contains({fold(c)}, {_s(f)})" for f in forms) + ")"

    return f"(CASE WHEN {any_in('title')} THEN 3 ELSE 0 END + CASE WHEN {any_in('category')} THEN 2 ELSE 0 END + CASE WHEN {any_in('summary')} THEN 1 ELSE 0 END)"


_K = {"english": ["english"], "the": ["the", "with"], "and": ["and"], "tion": ["tion", "ing"], "장학": ["장학", "학자금"], "채용": ["채용", "모집"], "복지": ["복지"]}
RELEVANCE = f"""{CURRENT}, k AS (
    SELECT *, {', '.join(f'{_score(v)} AS k{i}' for i, v in enumerate(_K.values()))} FROM c
), s AS (
    SELECT *, k0 + k1 + k2 + k3 + k4 + k5 + k6 + CASE WHEN list_has_any(topics, ['english', 'first', 'second', 'third', 'the', 'and', 'tion', '장학', '채용', '복지']) THEN 1 ELSE 0 END AS score,
           k1 + k2 AS s1, k3 + k4 AS s2, k5 + k6 AS s3,
           list_sort(list_filter([{', '.join(f"{{'s': -k{i}, 'k': {_s(n)}}}" for i, n in enumerate(_K))}], lambda x: x.s < 0)) AS hits
    FROM k WHERE k0 + k1 + k2 + k3 + k4 + k5 + k6 > 0
), m AS (
    SELECT *, array_to_string([h.k FOR h IN hits], '|') AS matched,
           CASE WHEN greatest(s1, s2, s3) = 0 THEN '{rules.OTHER}' WHEN s1 >= s2 AND s1 >= s3 THEN 'first' WHEN s2 >= s3 THEN 'second' ELSE 'third' END AS section
    FROM s
)"""
ATTEMPTS = f"""a AS (
    SELECT CAST(event_id // 15 AS INTEGER) AS src_idx, (['보도자료', '공지', '채용'])[1 + (event_id // 5) % 3] AS category, CAST(event_id % 5 AS INTEGER) AS stage_ord,
           ({_list(rules.STAGES)})[1 + event_id % 5] AS stage, user_id % 4 <> 0 AS robots_ok, user_id % 3 <> 0 AS fetched, CAST(user_id % 5 AS INTEGER) AS n_rows
    FROM events
), w AS (
    SELECT *, robots_ok AND fetched AND n_rows > 0 AS ok, min(CASE WHEN robots_ok AND fetched AND n_rows > 0 THEN stage_ord END) OVER (PARTITION BY src_idx, category) AS winner FROM a
)"""
LOW = "lower(url)"
LABEL = f"({_list(LABELS)})[1 + page_id % 12]"
HITS = " + ".join(f"CAST(contains({LOW}, '{h}') AS INTEGER)" for h in rules.BOARD_HINTS)
BOARD = f"""(least({HITS}, 3) * 2 + CASE WHEN {' OR '.join(f"contains({LOW}, '{h}')" for h in rules.QUERY_HINTS)} THEN 2 ELSE 0 END
    + CASE WHEN {' OR '.join(f"contains({LOW}, '{a}')" for a in sorted({a for _, ws in rules.CATEGORY_HINTS for w in ws for a in aliases(w)}))} THEN 3 ELSE 0 END
    - CASE WHEN {' OR '.join(f"contains({LOW}, '{h}')" for h in rules.INTRO_HINTS)} THEN 3 ELSE 0 END + CASE WHEN {classify('label')} <> '' THEN 3 ELSE 0 END
    - least(abs(length(regexp_replace(rtrim(split_part({LOW}, '?', 1), '/'), '[^/]', '', 'g')) - 2 - 3), 3))"""
HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
RANK = "CASE name " + " ".join(f"WHEN '{n}' THEN {i if n in rules.SPECIFIC else 100 + i}" for i, (n, _) in enumerate(rules.CATEGORY_HINTS)) + f" ELSE {100 + len(rules.CATEGORY_HINTS)} END"


def _date(c: str = "raw") -> str:
    """Dates in RE2: a mark before or after stands for a look around."""

    def made(x, pattern, g=(1, 2, 3), century=""):
        y, m, d = (f"regexp_extract({x}, {_s(pattern)}, {i})" for i in g)
        return f"WHEN regexp_matches({x}, {_s(pattern)}) THEN TRY_CAST('{century}' || {y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"

    t, mail = f"trim({c})", r"(\d{1,2})\s+([A-Za-z]{3})\s+(\d{4})"
    month = f"list_position(['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'], regexp_extract({t}, {_s(mail)}, 2))"
    parts = (
        made(t, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"),
        made(t, r"^(\d{4})(\d{2})(\d{2})$"),
        f"WHEN {month} > 0 THEN TRY_CAST(regexp_extract({t}, {_s(mail)}, 3) || '-' || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({t}, {_s(mail)}, 1), 2, '0') AS DATE)",
        made(t, r"(?:^|[^\p{L}\p{N}_])(20\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})(?:$|[^\p{L}\p{N}_])"),
        made(t, r"(20\d{2})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일"),
        made(t, r"(?:^|\D)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?:$|\D)"),
        made(t, r"(?:^|[^\d.])(\d{2})[.\-/](\d{1,2})[.\-/](\d{1,2})(?:$|[^\d.])", century="20"),
    )
    return "CASE " + " ".join(parts) + " END"


def _mixed(key: str, *lists) -> str:
    parts, step = [], 1
    for values in lists:
        parts.append(f"({_list(values)})[1 + ({key} // {step}) % {len(values)}]")
        step *= len(values)
    return " || ".join(parts)


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _escape(word: str) -> str:
    return word.replace("+", "\\+")


_ONE = "(" + "|".join(_escape(w) for w in rules.MEANINGLESS if " " not in w) + ")"
_GLUED = "^(" + "|".join(_escape(w.replace(" ", "")) for w in rules.MEANINGLESS) + ")+$"


def _tidy(src: str, cols: str) -> str:
    """CTEs t1 to t3; t3 has ``label``."""
    tail = r"\s*[(\[]?\s*(게시판\s*)?목록\s*[)\]]?$"
    return rf"""t1 AS (SELECT {cols}, trim(regexp_replace(regexp_replace({_flat('raw')}, '([가-힣])\+([가-힣])', '\1 \2', 'g'), '^[-–·•▶▷►>»※\s]+', '')) AS flat FROM {src}),
        t2 AS (SELECT *, trim(regexp_replace(regexp_replace(flat, '((^| ){_ONE})+$', '', 'i'), '^({_ONE}( |$))+', '', 'i')) AS bare FROM t1),
        t3 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(bare, '(더\s*보기|바로\s*가기|\+)+$', '', 'i'), '\s+더$', ''), '([가-힣])more$', '\1', 'i'), '\s+more$', '', 'i')) AS cut FROM t2),
        t4 AS (SELECT *, CASE WHEN regexp_matches(lower(replace(flat, ' ', '')), {_s(_GLUED)}) OR bare = '' OR regexp_matches(lower(replace(bare, ' ', '')), {_s(_GLUED)}) THEN ''
            ELSE trim(regexp_replace(CASE WHEN length(cut) >= 2 THEN cut ELSE bare END, {_s(tail)}, '')) END AS label FROM t3)"""


def _slot(c: str) -> str:
    taken = f"{c} <> '' AND length({c}) <= 20 AND NOT regexp_matches({c}, {_s(rules.NOT_NOTICE)}) AND NOT regexp_matches({c}, {_s(rules.YEAR_IN_LABEL)})"
    return f"CASE WHEN {taken} AND {classify(c)} IN ('공지', '학사', '장학', '입학', '채용') THEN {classify(c)} ELSE '' END"


#: Addresses and what each is.
URL_SHAPES = (
    ("https://a.kr/", "home"), ("https://a.kr/index.do", "home"), ("https://a.kr/base/main/view", "home"), ("https://a.kr/kor/", "home"), ("https://a.kr/x?pCode=main", "home"),
    ("https://a.kr/index.do?menuNo=3", "board"), ("https://a.kr/main/163", "board"), ("https://a.kr/bbs/list.do", "board"), ("https://a.kr/s/1/subview.do", "board"),
    ("https://a.kr/bbs/s/1/2/artclView.do", "article"), ("https://a.kr/b.php?bo=1&wr_id=12", "article"), ("https://a.kr/n/view.do?no=1", "article"), ("https://a.kr/blog/a-title/", "article"),
    ("https://a.kr/s/1/subview.do?enc=Zm5jdDF8QEB8L2Jicy9zLzEvMi9hcnRjbFZpZXcuZG8", "article"), ("https://a.kr/web/search.do?q=x", "search"),
)
URLS = tuple(u for u, _ in URL_SHAPES)
PATHS = ("/gongji/list.do", "/news/haksa.jsp", "/x?bid=1", "/chaeyong#job", "/janghak/", "", "/press/1")


def _clusters(source: str, rank: str, part: str = "''") -> str:
    """Leader clustering by a scan: CTE ``cl`` has the rows of ``source`` with leader rank ``lead``.

    Tokens are made ones of a row's part, so only rows of one part are near.  The scan carries
    the list of leaders; a row leads if none of the earlier rows near it leads.
    """
    return f"""r0 AS (SELECT *, CAST(row_number() OVER (ORDER BY {rank}) AS INTEGER) AS rk, {part} AS part FROM {source}),
        tk AS (SELECT DISTINCT rk, part, {fold('t')} AS t FROM (SELECT rk, part, unnest([regexp_replace(w, {STEM}) FOR w IN regexp_extract_all(title, '{rules.TOKEN}')]) AS t FROM r0) WHERE {TOPICAL}),
        sz AS (SELECT rk, count(*) AS n FROM tk GROUP BY rk),
        ov AS (SELECT a.rk AS i, b.rk AS j, count(*) AS k FROM tk a JOIN tk b ON a.t = b.t AND a.part = b.part AND a.rk < b.rk GROUP BY 1, 2),
        nr AS (SELECT i, j, k, x.n + y.n - k AS u FROM ov JOIN sz x ON x.rk = i JOIN sz y ON y.rk = j WHERE 2 * k >= x.n + y.n - k),
        nb AS (SELECT j AS rk, list(i) AS before FROM nr GROUP BY j),
        st AS (SELECT rk, coalesce(before, []) AS before FROM r0 LEFT JOIN nb USING (rk)),
        sc AS (SELECT 0 AS step, CAST([] AS INTEGER[]) AS leaders UNION ALL
               SELECT sc.step + 1, CASE WHEN list_has_any(st.before, sc.leaders) THEN sc.leaders ELSE list_append(sc.leaders, st.rk) END FROM sc JOIN st ON st.rk = sc.step + 1),
        ld AS (SELECT unnest(leaders) AS rk FROM (SELECT leaders FROM sc ORDER BY step DESC LIMIT 1)),
        bs AS (SELECT j AS rk, i AS lead FROM nr JOIN ld ON ld.rk = i QUALIFY row_number() OVER (PARTITION BY j ORDER BY k / u DESC, i) = 1),
        cl AS (SELECT r0.*, CASE WHEN r0.rk IN (SELECT rk FROM ld) THEN r0.rk ELSE coalesce(bs.lead, r0.rk) END AS lead FROM r0 LEFT JOIN bs USING (rk))"""


NEWEST = "published DESC NULLS LAST, title, src_idx, item_idx"
CLUSTERS = f"{CURRENT}, {_clusters('c', NEWEST)}"
ISSUES = f"""{CLUSTERS}, g AS (SELECT lead, count(*) AS n, count(DISTINCT agency) AS agencies FROM cl GROUP BY lead HAVING count(*) >= 2),
        iss AS (SELECT CAST(row_number() OVER (ORDER BY g.n DESC, h.published DESC NULLS LAST, h.title, h.src_idx, h.item_idx) AS INTEGER) AS pos, h.title, g.n, g.agencies, g.lead FROM g JOIN cl h ON h.rk = g.lead QUALIFY pos <= 5)"""
BRIEF = f"{RELEVANCE}, m6 AS (SELECT * FROM m WHERE score >= 6), {_clusters('m6', NEWEST, 'section')}"



def _weekly(source: str, weeks: int) -> str:
    return f"""g AS (SELECT CAST(date_trunc('week', published) AS DATE) AS week, count(*) AS n FROM {source} WHERE published IS NOT NULL GROUP BY 1),
    spine AS (SELECT CAST(unnest(generate_series(max(week) - INTERVAL ({7 * (weeks - 1)}) DAY, max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM g),
    wk AS (SELECT week, strftime(week, '%m/%d') AS label, coalesce(n, 0) AS n FROM spine LEFT JOIN g USING (week))"""


SQL = {
    "digest_agencies": f"WITH {CURRENT} SELECT agency, count(*) AS n FROM c GROUP BY agency ORDER BY n DESC, agency LIMIT 12",
    "digest_categories": f"WITH {CURRENT} SELECT {NAME} AS category, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "digest_etc": f"WITH {CURRENT} SELECT category AS label, count(*) AS n FROM c WHERE {NAME} = '{rules.OTHER}' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10",
    "digest_totals": f"""WITH {CURRENT}, a AS (SELECT agency AS name, count(*) AS n FROM c GROUP BY 1), b AS (SELECT {NAME} AS name, count(*) AS n FROM c GROUP BY 1),
        ta AS (SELECT n FROM a ORDER BY n DESC, name LIMIT 5), tb AS (SELECT n FROM b ORDER BY n DESC, name LIMIT 5)
        SELECT CAST((SELECT sum(n) FROM a) AS BIGINT) AS total, (SELECT count(*) FROM a) AS distinct_agency, greatest(0, (SELECT count(*) FROM a) - (SELECT count(*) FROM ta)) AS agency_more,
               CAST((SELECT sum(n) FROM a) - (SELECT sum(n) FROM ta) AS BIGINT) AS agency_rest, (SELECT count(*) FROM b) AS distinct_category,
               greatest(0, (SELECT count(*) FROM b) - (SELECT count(*) FROM tb)) AS category_more, CAST((SELECT sum(n) FROM b) - (SELECT sum(n) FROM tb) AS BIGINT) AS category_rest""",
    "digest_keywords": f"""WITH {CURRENT}, e AS (SELECT unnest(list_distinct(regexp_extract_all(title, '{rules.TOKEN}'))) AS t FROM c),
        skip AS (SELECT {fold('agency')} AS t FROM c UNION SELECT unnest([{fold('u')} FOR u IN regexp_extract_all(agency, '{rules.TOKEN}')]) FROM c)
        SELECT * FROM (SELECT t AS word, count(*) AS n FROM e WHERE {TOPICAL} AND {fold('t')} NOT IN (SELECT t FROM skip) GROUP BY t ORDER BY n DESC, t LIMIT 8)
        WHERE n >= CASE WHEN (SELECT count(*) FROM c) = 1 THEN 1 ELSE 2 END""",
    "tokens_title": f"""WITH {NOTICES_SQL}, e AS (SELECT item_idx, unnest([regexp_replace(w, {STEM}) FOR w IN regexp_extract_all(title, '{rules.TOKEN}')]) AS t FROM n),
        g AS (SELECT item_idx, array_to_string(list_sort(list(DISTINCT {fold('t')})), ' ') AS tokens FROM e WHERE {TOPICAL} GROUP BY item_idx)
        SELECT n.item_idx, coalesce(tokens, '') AS tokens FROM n LEFT JOIN g USING (item_idx)""",
    "tokens_strip_suffix": f"""WITH {NOTICES_SQL}, e AS (SELECT item_idx, regexp_extract_all(title, '{rules.TOKEN}') AS ws FROM n), x AS (SELECT item_idx, unnest(range(len(ws))) AS pos, ws FROM e),
        w AS (SELECT item_idx, CAST(pos AS INTEGER) AS pos, ws[pos + 1] || CASE WHEN pos % 3 = 0 THEN '' ELSE ({_list(rules.SUFFIXES)})[1 + (item_idx + pos) % {len(rules.SUFFIXES)}] END AS word FROM x)
        SELECT item_idx, pos, word, regexp_replace(word, {STEM}) AS stem FROM w""",
    "date_parse": f"WITH w AS (SELECT doc_id AS item_idx, {_mixed('doc_id', DATES, DATE_HEADS, DATE_TAILS)} AS raw FROM documents) SELECT item_idx, raw, {_date()} AS day FROM w",
    "label_tidy": f"""WITH w AS (SELECT doc_id AS item_idx, {_mixed('doc_id', LABEL_CORES, LABEL_HEADS, LABEL_TAILS)} AS raw FROM documents), {_tidy('w', 'item_idx, raw')}
        SELECT item_idx, raw, label, {_slot('label')} AS slot FROM t4""",
    "category_classify": f"""WITH {NOTICES_SQL} SELECT item_idx, {classify('category')} AS found, {canonical('category')} AS name,
        CASE WHEN {canonical('category')} IN ({', '.join(map(_s, rules.SPECIFIC))}) THEN category ELSE coalesce(nullif({_first("(category || ' ' || title)", rules.TITLE_HINTS)}, ''), category) END AS notice_category FROM n""",
    "rights_gate": f"""WITH {NOTICES_SQL}, t AS (SELECT item_idx, CASE WHEN lower(trim(rights)) IN ({', '.join(map(_s, rules.TIERS))}) THEN lower(trim(rights)) ELSE 'unknown' END AS tier FROM n)
        SELECT item_idx, tier, CASE tier {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.TIER_BADGES.items())} END AS badge, tier NOT IN ({', '.join(map(_s, rules.NO_DERIVATIVES))}) AS derivative FROM t""",
    "text_clean": f"WITH {NOTICES_SQL} SELECT item_idx, summary FROM n",
    "collect_report": f"""WITH {CURRENT} SELECT CAST(row_number() OVER (ORDER BY published DESC NULLS LAST, agency DESC, src_idx, item_idx) AS INTEGER) AS rank, item_idx, agency, published, title,
        CASE WHEN {DERIVATIVE} THEN summary ELSE '' END AS summary FROM c QUALIFY rank <= 50""",
    "collect_agency_filter": f"""WITH {NOTICES_SQL}, c AS (SELECT * FROM n WHERE {SINCE} AND contains(agency, 'src1') QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY src_idx, item_idx) = 1)
        SELECT item_idx, agency, published, summary FROM c""",
    "collect_dedup": f"WITH {NOTICES_SQL} SELECT src_idx, item_idx, url FROM n QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY src_idx, item_idx) = 1",
    "collect_inherit": f"""WITH {NOTICES_SQL} SELECT item_idx, CASE WHEN src_idx % 2 = 0 THEN 'S' || src_idx ELSE agency END AS unit,
        CASE WHEN item_idx % 5 = 0 THEN org ELSE 'O' || src_idx END AS org, CASE WHEN site <> '' THEN site WHEN src_idx % 2 = 0 THEN 'S' || src_idx ELSE '' END AS site,
        CASE WHEN len(topics) > 0 THEN array_to_string(topics, '|') ELSE '행사' END AS topics FROM n""",
    "state_mark_new": f"WITH {CURRENT}, {SEEN} SELECT item_idx, {KEY} NOT IN (SELECT key FROM seen) AS is_new FROM c",
    "state_only_new": f"WITH {CURRENT}, {SEEN} SELECT item_idx, url FROM c WHERE {KEY} NOT IN (SELECT key FROM seen)",
    "state_merge": f"""WITH {CURRENT}, {SEEN}, now AS (SELECT DISTINCT {KEY} AS key FROM c WHERE agency = 'src3'),
        u AS (SELECT 0 AS part, 0 AS place, key FROM now UNION ALL SELECT 1, pos, key FROM seen WHERE key NOT IN (SELECT key FROM now))
        SELECT CAST(row_number() OVER (ORDER BY part, place, key) - 1 AS INTEGER) AS pos, key FROM u QUALIFY pos < 20000""",
    "group_by_agency": f"WITH {CURRENT} SELECT agency, count(*) AS n, max(published) AS latest, count(published) AS dated FROM c GROUP BY agency",
    "group_by_topic": f"""WITH {CURRENT}, g AS (SELECT topic, count(*) AS n FROM (SELECT unnest(CASE WHEN len(topics) = 0 THEN ['{rules.OTHER}'] ELSE topics END) AS topic FROM c) GROUP BY 1)
        SELECT CAST(row_number() OVER (ORDER BY CASE WHEN topic = '{rules.OTHER}' THEN 1 ELSE 0 END, n DESC, topic) AS INTEGER) AS pos, topic, n FROM g""",
    "group_by_org": f"""WITH {CURRENT}, g AS (SELECT coalesce(nullif(org, ''), agency) AS org, coalesce(nullif(site, ''), agency) AS site, count(*) AS n FROM c GROUP BY 1, 2),
        h AS (SELECT *, CAST(sum(n) OVER (PARTITION BY org) AS BIGINT) AS org_n FROM g) SELECT CAST(row_number() OVER (ORDER BY org_n DESC, org, n DESC, site) AS INTEGER) AS pos, org, site, n, org_n FROM h""",
    "orders_by_region": f"""WITH {ORDERS_SQL}, g AS (SELECT org, agency AS site, count(*) AS n FROM o GROUP BY 1, 2), h AS (SELECT *, CAST(sum(n) OVER (PARTITION BY org) AS BIGINT) AS org_n FROM g)
        SELECT CAST(row_number() OVER (ORDER BY org_n DESC, org, n DESC, site) AS INTEGER) AS pos, org, site, n, org_n FROM h""",
    "weekly_counts": f"WITH ev AS (SELECT CAST(ts AS DATE) AS published FROM events), {_weekly('ev', 8)} SELECT week, label, n FROM wk",
    "weekly_trend": f"""WITH {ORDERS_SQL}, {_weekly('o', 40)}, r AS (SELECT n, row_number() OVER (ORDER BY week) AS rank, count(*) OVER () AS size FROM wk),
        t AS (SELECT CAST(sum(CASE WHEN rank <= size // 2 THEN n ELSE 0 END) AS BIGINT) AS previous, CAST(sum(CASE WHEN rank > size // 2 THEN n ELSE 0 END) AS BIGINT) AS recent, count(*) AS weeks FROM r)
        SELECT previous, recent, CAST(round_even((recent - previous) / nullif(previous, 0) * 100, 0) AS BIGINT) AS percent,
               CASE WHEN weeks < 4 OR (previous = 0 AND recent = 0) THEN '' WHEN previous = 0 THEN 'started' WHEN (recent - previous) / previous * 100 >= 15 THEN 'up'
                    WHEN (recent - previous) / previous * 100 <= -15 THEN 'down' ELSE 'steady' END AS kind FROM t""",
    "agency_activity": f"WITH {ORDERS_SQL} SELECT agency, count(*) AS n, max(published) AS latest FROM o GROUP BY agency ORDER BY n DESC, agency LIMIT 6",
    "new_keywords": f"""WITH {CURRENT}, {SEEN}, f AS (SELECT *, {KEY} NOT IN (SELECT key FROM seen) AS is_new FROM c),
        e AS (SELECT item_idx, is_new, unnest([regexp_replace(w, {STEM}) FOR w IN regexp_extract_all(title, '{rules.TOKEN}')]) AS t FROM f),
        g AS (SELECT DISTINCT item_idx, is_new, {fold('t')} AS word FROM e WHERE {TOPICAL}),
        h AS (SELECT word, count_if(is_new) AS n, count_if(NOT is_new) AS old FROM g GROUP BY word)
        SELECT word, CAST(n AS BIGINT) AS n FROM h WHERE old = 0 AND (SELECT bool_or(is_new) AND bool_or(NOT is_new) FROM f) ORDER BY n DESC, word LIMIT 6""",
    "relevance_scores": f"WITH {RELEVANCE} SELECT item_idx, score, matched, section FROM m",
    "relevance_sections": f"WITH {RELEVANCE} SELECT section, count(*) AS n, max(score) AS best FROM m WHERE score >= 6 GROUP BY section",
    "relevance_select": f"WITH {RELEVANCE} SELECT item_idx, score, section FROM m WHERE score >= 6 ORDER BY score DESC, published DESC NULLS LAST, title, src_idx, item_idx LIMIT 40",
    "brief_keywords": f"WITH {RELEVANCE}, e AS (SELECT unnest([h.k FOR h IN hits]) AS word FROM m WHERE score >= 6) SELECT word, count(*) AS n FROM e GROUP BY word ORDER BY n DESC, word LIMIT 6",
    "web_rows": f"WITH {CURRENT} SELECT item_idx, title, url, strftime(published, '%Y-%m-%d') AS date, {NAME} AS \"group\", CASE WHEN site = '' OR site = org THEN '' ELSE site END AS unit FROM c",
    "cascade_first_success": f"WITH {ATTEMPTS} SELECT src_idx, category, stage, n_rows FROM w WHERE stage_ord = winner",
    "cascade_trail": f"""WITH {ATTEMPTS} SELECT src_idx, category, string_agg(stage || ': ' || CASE WHEN ok THEN n_rows || '건' WHEN NOT robots_ok THEN 'robots' WHEN NOT fetched THEN 'fetch failed' ELSE 'no rows' END, ' → ' ORDER BY stage_ord) AS trail,
        max(CAST(ok AS INTEGER)) AS succeeded FROM w WHERE winner IS NULL OR stage_ord <= winner GROUP BY src_idx, category""",
    "plan_routes": f"""WITH p AS (SELECT page_id % 7 AS org_id, page_id % 3 AS group_ord, page_id AS pos, {LABEL} AS category, url FROM pages),
        q AS (SELECT *, {canonical('category')} AS name FROM p QUALIFY row_number() OVER (PARTITION BY org_id, lower(regexp_replace(trim(url), '#.*$', '')) ORDER BY group_ord, pos) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY org_id, name ORDER BY group_ord, pos) AS level FROM q),
        s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY org_id ORDER BY level, {RANK}, group_ord, pos) <= 15)
        SELECT org_id, CAST(row_number() OVER (PARTITION BY org_id ORDER BY group_ord, pos) AS INTEGER) AS place, category, url FROM s""",
    "fair_order": f"""WITH p AS (SELECT page_id % 5 AS home, {LABEL} AS label, url FROM pages), q AS (SELECT *, {canonical('label')} AS category, CAST({BOARD} AS INTEGER) AS score FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY home, category ORDER BY score DESC, url) AS turn, max(score) OVER (PARTITION BY home, category) AS best FROM q)
        SELECT home, CAST(row_number() OVER (PARTITION BY home ORDER BY turn, best DESC, category) AS INTEGER) AS place, category, url, score FROM r""",
    "board_score": f"WITH p AS (SELECT page_id, url, {LABEL} AS label FROM pages) SELECT page_id, CAST({BOARD} AS INTEGER) AS score FROM p",
    "dominant_category": f"""WITH {NOTICES_SQL}, t AS (SELECT item_idx // 40 AS board, CASE WHEN item_idx % 5 < 4 THEN CASE WHEN (item_idx // 40) % 2 = 0 THEN '장학생 선발' ELSE '직원 채용' END ELSE title END AS title FROM n),
        g AS (SELECT board, {_first('title', rules.TITLE_HINTS)} AS name, count(*) AS n FROM t GROUP BY 1, 2), h AS (SELECT board, sum(n) AS total FROM g GROUP BY board),
        b AS (SELECT * FROM g WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY board ORDER BY n DESC, CASE name {' '.join(f"WHEN '{n}' THEN {i}" for i, (n, _) in enumerate(rules.TITLE_HINTS))} END) = 1)
        SELECT h.board, CASE WHEN b.n >= 2 AND b.n * 100 >= 60 * total THEN b.name ELSE '' END AS category, CAST(total AS BIGINT) AS total FROM h LEFT JOIN b USING (board)""",
    "bake_upsert": """WITH c AS (SELECT c_custkey AS id, c_custkey % 9 AS count, DATE '2024-01-01' AS checked FROM customer WHERE c_custkey % 2 = 0),
        f AS (SELECT c_custkey AS id, c_custkey % 11 AS count, DATE '2024-02-01' AS checked, CASE WHEN c_custkey % 5 = 0 THEN 'timeout' WHEN c_custkey % 7 = 0 THEN 'none' ELSE 'ok' END AS status FROM customer WHERE c_custkey % 2 <> 0 OR c_custkey % 3 = 0),
        j AS (SELECT id, CASE WHEN status IS NULL OR status = 'timeout' THEN c.count ELSE f.count END AS count, CASE WHEN status IS NULL OR status = 'timeout' THEN c.checked ELSE f.checked END AS checked, status FROM c FULL JOIN f USING (id))
        SELECT id, count, checked FROM j WHERE coalesce(status, '') <> 'none' AND count IS NOT NULL""",
    "access_verdicts": """WITH k AS (SELECT l_orderkey % 500 AS org, CASE WHEN l_orderkey % 500 % 9 = 0 THEN 'korea' ELSE 'rss' END AS label, (l_suppkey + l_orderkey % 500) % 3 <> 0 AS allowed FROM lineitem WHERE l_linenumber > 1),
        p AS (SELECT org, count(*) AS paths, count_if(allowed) AS allowed, count_if(label = 'rss') AS own FROM k GROUP BY org),
        r AS (SELECT l_orderkey % 500 AS org, bool_or(l_linestatus = 'O') AS root FROM lineitem WHERE l_linenumber = 1 GROUP BY 1),
        j AS (SELECT org, coalesce(paths, 0) AS paths, coalesce(allowed, 0) AS allowed, coalesce(own, 0) AS own, coalesce(root, false) AS root FROM p FULL JOIN r USING (org))
        SELECT org, CAST(paths AS BIGINT) AS paths, CAST(allowed AS BIGINT) AS allowed, CASE WHEN paths > 0 AND own = 0 THEN 'korea_only' WHEN paths > 0 AND allowed = paths THEN 'full' WHEN allowed > 0 THEN 'partial' WHEN root THEN 'paths' ELSE 'blocked' END AS verdict FROM j""",
    "external_urls": f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), b AS (SELECT *, regexp_replace(host, '^www\\.', '') AS bare FROM h)
        SELECT page_id, host, {' OR '.join(f"bare = '{x}' OR bare LIKE '%.{x}'" for x in rules.EXTERNAL_HOSTS)} OR NOT (bare = 'example.com' OR bare LIKE '%.example.com') AS external FROM b""",
    "attachment_kind": """WITH u AS (SELECT page_id, lower(url || (['', '.pdf', '.HWP', '.docx?x=1', '.zip#a', '.csv'])[1 + page_id % 6]) AS url FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(url, '\\.pdf($|[?#])') THEN 'PDF' WHEN regexp_matches(url, '\\.hwpx?($|[?#])') THEN 'HWP' WHEN regexp_matches(url, '\\.docx?($|[?#])') THEN 'DOC'
            WHEN regexp_matches(url, '\\.xlsx?($|[?#])') THEN 'XLS' WHEN regexp_matches(url, '\\.pptx?($|[?#])') THEN 'PPT' WHEN regexp_matches(url, '\\.zip($|[?#])') THEN 'ZIP'
            WHEN regexp_matches(url, '\\.csv($|[?#])') THEN 'CSV' ELSE '' END AS kind FROM u""",
    "url_shapes": f"""WITH u AS (SELECT doc_id AS item_idx, ({_list(URLS)})[1 + doc_id % {len(URLS)}] AS url FROM documents)
        SELECT item_idx, url IN ({', '.join(_s(u) for u, s in URL_SHAPES if s == 'home')}) AS home, url IN ({', '.join(_s(u) for u, s in URL_SHAPES if s == 'article')}) AS article,
               url IN ({', '.join(_s(u) for u, s in URL_SHAPES if s == 'search')}) AS search FROM u""",
    "alt_urls": f"""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://)', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1) AS r FROM pages)
        SELECT page_id, CASE WHEN starts_with(h, 'www.') THEN s || 'm.' || h[5:] || r || ' ' || s || h[5:] || r ELSE s || 'www.' || h || r END AS urls FROM u""",
    "category_from_url": f"""WITH u AS (SELECT page_id, split_part(split_part(url || ({_list(PATHS)})[1 + page_id % {len(PATHS)}], '?', 1), '#', 1) AS path FROM pages)
        SELECT page_id, CASE {' '.join("WHEN " + " OR ".join(f"contains(lower(path), {_s(a)})" for w in words for a in ((w,) if w.isascii() else aliases(w))) + f" THEN {_s(n)}" for n, words in rules.CATEGORY_HINTS)} ELSE '{rules.OTHER}' END AS category FROM u""",
    "audit_report": f"""WITH {ATTEMPTS}, t AS (SELECT src_idx, category, max(CAST(ok AS INTEGER)) AS ok, sum(CASE WHEN ok THEN n_rows ELSE 0 END) AS n FROM w WHERE winner IS NULL OR stage_ord <= winner GROUP BY 1, 2)
        SELECT category, count(*) AS boards, count_if(ok = 1) AS connected, CAST(sum(n) AS BIGINT) AS rows FROM t GROUP BY category""",
    "mined_urls": f"""WITH p AS (SELECT page_id, {HOST} AS home, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base,
            replace(html || '<script>var a="/bbs/list.do?menuNo=' || page_id || '", b="https:\\/\\/x.example.com\\/board\\/list", c="' || regexp_replace(url, '[?#].*$', '') || '/notice/bbs/", d="/a.css"</script>', '\\/', '/') AS src FROM pages),
        r AS (SELECT page_id, home, base, unnest(list_distinct(regexp_extract_all(src, '["''](/[^"''\\s<>]{{2,160}}|https?://[^"''\\s<>]{{4,200}})["'']', 1))) AS raw FROM p),
        u AS (SELECT DISTINCT page_id, home, regexp_replace(CASE WHEN raw LIKE '/%' THEN base || raw ELSE raw END, '#.*$', '') AS url FROM r WHERE raw NOT LIKE '//%'),
        h AS (SELECT page_id, url, regexp_replace(home, '^www\\.', '') AS own, regexp_replace({HOST}, '^www\\.', '') AS host, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path, '' AS label FROM u),
        q AS (SELECT page_id, url, CAST({BOARD} AS INTEGER) AS score FROM h WHERE (host = own OR ends_with(host, '.' || own)) AND NOT ({' OR '.join(f"host = '{x}' OR ends_with(host, '.{x}')" for x in rules.EXTERNAL_HOSTS)})
            AND path NOT IN ('', '/') AND NOT ({' OR '.join(f"ends_with(path, '{x}')" for x in rules.ASSET_TAILS)}))
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INTEGER) AS place, url, score FROM q WHERE score > 0 QUALIFY place <= 30""",
    "page_anchors": """WITH a AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*') AS base, unnest(range(len(regexp_extract_all(html, '<a href="')))) AS i, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
            unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text FROM pages),
        u AS (SELECT page_id, base || href AS url, min(i) AS i, arg_min(text, i) AS text FROM a GROUP BY 1, 2)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, url, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM u""",
    "deep_links": """WITH p AS ({anchors}), q AS (SELECT page_id, pos, url || CASE WHEN pos % 2 = 0 THEN '.pdf' ELSE '' END AS url, left(trim(text), 60) AS raw FROM p),
        r AS (SELECT page_id, pos, url, CASE WHEN lower(raw) IN ('', '바로가기', 'more', '더보기', '목록', '이전', '다음', '인쇄', '공유') THEN '' ELSE raw END AS label FROM q),
        k AS (SELECT *, CASE WHEN ends_with(lower(url), '.pdf') THEN 'PDF' WHEN regexp_matches(lower(url || ' ' || label), 'download|filedown|file_down') THEN '링크' END AS kind FROM r)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS place, CASE WHEN label <> '' THEN label ELSE left(regexp_extract(url, '[^/]*$'), 60) END AS label, url, kind FROM k WHERE kind IS NOT NULL QUALIFY place <= 5""",
    "file_kinds": f"""WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || ({_list(FILE_TAILS)})[1 + page_id % {len(FILE_TAILS)}] AS url, ({_list(FILE_LABELS)})[1 + (page_id // {len(FILE_TAILS)}) % {len(FILE_LABELS)}] AS text FROM pages),
        q AS (SELECT page_id, text, lower(regexp_extract(url, '^[a-z]+://[^/?]*([^?]*)', 1)) AS path, lower(regexp_extract(url, '\\?(.*)$', 1)) AS query FROM p), r AS (SELECT *, regexp_extract(path, '[^/]*$') AS last FROM q)
        SELECT page_id, regexp_matches(last, '\\.(pdf|hwpx?|docx?|xlsx?|pptx?|zip|csv|jpe?g|png|gif|bmp|webp)$|download|filedown|getfile') OR regexp_matches(query, '(^|&)(mode|act|cmd|type|method)=(download|down|filedown)(&|$)') AS file,
               CASE WHEN ends_with(path, '.hwp') THEN 'HWP' WHEN ends_with(path, '.png') OR ends_with(text, '.jpg') THEN '그림' WHEN contains(query, 'preview') OR regexp_matches(text, '미리보기|바로보기') THEN '보기'
                    WHEN regexp_matches(path || '?' || query, 'download|filedown|file_down|fileid|atchfile|filesn|file_sn|getfile|attach') AND (query <> '' OR contains(last, '.')) THEN CASE WHEN contains(last, 'zip') THEN 'ZIP' ELSE '파일' END ELSE '' END AS kind,
               CASE WHEN contains(text, '공고문') THEN '공고문.pdf' WHEN contains(text, '자료집') THEN '자료집' WHEN contains(text, '사진') THEN '사진.jpg' ELSE '' END AS label FROM r""",
    "sitemap_rows": f"""WITH u AS (SELECT DISTINCT page_id // 10 AS page_id, regexp_replace(url, '[?#].*$', '') || '/board/list.do' AS url, '' AS label FROM pages), q AS (SELECT page_id, url, CAST({BOARD} AS INTEGER) AS score FROM u)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS INTEGER) AS place, url, score FROM q""",
    "home_variants": """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://)', 1) AS s, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)
        SELECT page_id, s || h || ' ' || s || CASE WHEN h LIKE 'www.%' THEN h[5:] ELSE 'www.' || h END AS sites FROM p""",
    "cluster_groups": f"WITH RECURSIVE {CLUSTERS} SELECT a.src_idx, a.item_idx, b.src_idx AS leader_src, b.item_idx AS leader_item FROM cl a JOIN r0 b ON b.rk = a.lead",
    "insight_issues": f"WITH RECURSIVE {ISSUES} SELECT pos, title, n, agencies FROM iss",
    "insight_timeline": f"""WITH RECURSIVE {ISSUES} SELECT place AS pos, day, title, agency FROM (SELECT CAST(row_number() OVER (ORDER BY cl.published ASC NULLS LAST, cl.title, cl.src_idx, cl.item_idx) AS INTEGER) AS place, coalesce(strftime(cl.published, '%Y-%m-%d'), '미상') AS day, cl.title AS title, cl.agency AS agency
        FROM cl JOIN iss ON iss.lead = cl.lead AND iss.pos = 1 QUALIFY place <= 6)""",
    "brief_issues": f"""WITH RECURSIVE {BRIEF}, sz2 AS (SELECT section, lead, count(*) AS n FROM cl GROUP BY 1, 2),
        hd AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY section, lead ORDER BY score DESC, CASE WHEN summary = '' THEN 1 ELSE 0 END, {NEWEST}) = 1)
        SELECT list_position(['first', 'second', 'third', '{rules.OTHER}'], section) AS section_ord, CAST(row_number() OVER (PARTITION BY section ORDER BY score DESC, n DESC, {NEWEST}) AS INTEGER) AS pos, section, title, score, n FROM hd JOIN sz2 USING (section, lead)""",
    "brief_totals": f"""WITH RECURSIVE {BRIEF}, {SEEN} SELECT (SELECT count(*) FROM c) AS considered, count(*) AS matches, count(DISTINCT section || '/' || lead) AS issues, count(DISTINCT agency) AS agencies,
        CAST(count_if({KEY} NOT IN (SELECT key FROM seen)) AS BIGINT) AS new FROM cl""",
    "report_agencies": f"WITH {CURRENT}, {SEEN} SELECT agency, count(*) AS n, CAST(count_if({KEY} NOT IN (SELECT key FROM seen)) AS BIGINT) AS new FROM c GROUP BY agency",
    "agency_rows": f"WITH {CURRENT} SELECT agency, CAST(row_number() OVER (PARTITION BY agency ORDER BY published DESC NULLS LAST, src_idx, item_idx) AS INTEGER) AS pos, item_idx, published, title FROM c",
    "verify_groups": f"""WITH {CURRENT}, g AS (SELECT org, {NAME} AS name, count(*) AS n FROM c GROUP BY 1, 2) SELECT org, CAST(sum(n) AS BIGINT) AS count, string_agg(name || '=' || n, ',' ORDER BY name) AS groups FROM g GROUP BY org""",
    "web_dedup": f"""WITH RECURSIVE {NOTICES_SQL}, {{keys}} SELECT org, item_idx FROM kept""",
    "web_contributing": f"""WITH RECURSIVE {NOTICES_SQL}, {{keys}} SELECT DISTINCT src_idx, item_idx // 40 AS route FROM kept""",
    "url_keys": """WITH p AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN 'k2:k.kr/bbs/site' || page_id % 5 || '/7/' ELSE lower(split_part(url, '#', 1)) END AS key FROM pages)
        SELECT page_id, key, left(trim(regexp_replace(lower(url), '[^a-z0-9가-힣]+', '-', 'g'), '-'), 40) AS slug FROM p""",
    "origin_tag": """WITH p AS (SELECT page_id, split_part(url, '#', 1) AS u FROM pages), q AS (SELECT page_id, u, regexp_extract(u, '^[a-z]+://([^/?]*)', 1) AS host, regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1) AS path FROM p)
        SELECT page_id, host || ' · ' || (['RSS 피드', '게시판', '게시판 목록', 'other'])[1 + page_id % 4] || ' · ' || CASE WHEN path = '' THEN '/' WHEN length(path) > 46 THEN left(path, 23) || '…' || right(path, 23) ELSE path END || '?bbsId=7&mid=a' || page_id AS origin FROM q""",
    "access_counts": """WITH v AS ({access}), g AS (SELECT verdict, count(*) AS n FROM v GROUP BY verdict)
        SELECT verdict, CASE verdict WHEN 'full' THEN '✓ 전 경로 허용' WHEN 'partial' THEN '◐ 일부 허용 — 열린 경로로 수집' WHEN 'paths' THEN '◐ 후보 경로만 차단 — 대체 경로 탐색 여지' WHEN 'blocked' THEN '✗ 전면 차단 — korea.kr·data.go.kr 만' ELSE '— 자체 경로 미설정 — 보도자료만' END AS label,
               n, CAST(row_number() OVER (ORDER BY verdict <> 'blocked', verdict) AS INTEGER) AS pos FROM g""",
    "route_cascade": f"WITH {{routed}} SELECT src_idx, category, route, stage, n_rows, trail, ok FROM rr",
    "failure_groups": f"WITH {{routed}} SELECT src_idx, category, string_agg(trail, ' / ' ORDER BY route) AS trails FROM rr GROUP BY src_idx, category HAVING NOT bool_or(ok)",
    "failure_reasons": f"WITH {ATTEMPTS} SELECT CASE WHEN NOT robots_ok THEN 'robots' WHEN NOT fetched THEN 'fetch failed' ELSE 'no rows' END AS reason, count(*) AS n FROM w WHERE (winner IS NULL OR stage_ord <= winner) AND NOT ok GROUP BY 1",
    "source_registry": "WITH {sources} SELECT src_idx, id, name, kind, rights, enabled, topics, board_id, row, routes FROM s",
    "source_enabled": "WITH {sources} SELECT src_idx, name FROM s WHERE enabled",
    "catalog_checked": """WITH {sources} SELECT id, CASE WHEN org <> '' THEN org ELSE name END AS name, CASE WHEN src_idx % 2 = 0 THEN '정부' ELSE '학교' END AS section, home,
        id IN (SELECT id FROM s WHERE src_idx % 4 <> 1 AND routes > 0) AS checked FROM s WHERE kind = 'govorg' AND home <> '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY src_idx) = 1""",
    "org_index": """WITH {sources} SELECT CASE WHEN org <> '' THEN org ELSE name END AS org, count(DISTINCT CASE WHEN id LIKE 'src-%' THEN kind || ':' || CASE WHEN url <> '' THEN url ELSE home END ELSE id END) AS n, min(src_idx) AS first FROM s GROUP BY 1""",
    "stage_plan": """WITH {sources},
        r AS (SELECT src_idx, hm, unnest([{'c': '공지', 'k': 'board', 'u': hm || 'kor/b', 'o': 1}, {'c': '보도자료', 'k': 'rss', 'u': hm || 'press.xml', 'o': 2}, {'c': '공지', 'k': 'rss', 'u': hm || ' n.xml', 'o': 3}, {'c': '채용', 'k': 'datago', 'u': hm, 'o': 4}]) AS r FROM s WHERE kind = 'govorg' AND routes > 0),
        f AS (SELECT src_idx, r.c AS category, r.k AS kind, r.u AS url, r.o AS o FROM r),
        x AS (SELECT src_idx, category, CASE kind WHEN 'rss' THEN 0 WHEN 'board' THEN 1 ELSE 3 END AS a, o * 10 AS b, kind AS stage, url FROM f
              UNION ALL SELECT src_idx, category, 2, o * 10, 'alt', replace(url, '://www.', '://m.') FROM f
              UNION ALL SELECT src_idx, category, 2, o * 10 + 1, 'alt', replace(url, '://www.', '://') FROM f
              UNION ALL SELECT src_idx, category, 2, o * 10 + 2, 'alt', replace(url, '/kor/', '/eng/') FROM f WHERE contains(url, '/kor/')
              UNION ALL SELECT src_idx, '보도자료', 9, 0, 'korea', 'https://www.korea.kr/rss/' || feed || '.xml' FROM s WHERE kind = 'govorg' AND feed <> ''
              UNION ALL SELECT src_idx, '정책', 0, 0, kind, url FROM s WHERE kind NOT IN ('govorg', 'k2web')
              UNION ALL SELECT src_idx, '정책', 0, i, ['rss', 'list', 'page'][i], ['https://h' || k || '.kr/bbs/s/' || board_id || '/rssList.do?row=50', 'https://h' || k || '.kr/bbs/s/' || board_id || '/artclList.do', 'https://h' || k || '.kr/s/5/subview.do'][i]
                  FROM s, unnest([1, 2, 3]) AS t(i) WHERE kind = 'k2web' AND board_id IS NOT NULL AND (i < 3 OR k % 8 = 2))
        SELECT src_idx, CAST(CASE WHEN category = '채용' THEN 2 WHEN category = '보도자료' AND src_idx IN (SELECT src_idx FROM f) THEN 1 ELSE 0 END AS INTEGER) AS cat_ord, category, CAST(row_number() OVER (PARTITION BY src_idx, category ORDER BY a, b) - 1 AS INTEGER) AS stage_ord, stage, url FROM x""",
    "media_hosts": f"SELECT DISTINCT regexp_replace({HOST}, '^www\\.', '') AS host FROM pages WHERE contains({HOST}, '.')",
    "media_allowed": f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN {HOST} = 'example.org' OR {HOST} LIKE '%.example.org' WHEN 1 THEN true ELSE false END AS allowed FROM pages",
    "robots_allowed": f"SELECT DISTINCT url, {HOST} LIKE '%.org' OR NOT starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/en/') AS allowed, CASE WHEN {HOST} LIKE '%.org' THEN 0 ELSE 4 END AS delay FROM pages",
    "board_rows": f"""WITH {NOTICES_SQL}, q AS (SELECT *, item_idx // 50 AS page_id, 'Post ' || regexp_extract(title, '^[A-Za-z]*') || ' & 안내 ' || item_idx || '호' AS name FROM n),
        g AS (SELECT page_id, count(published) AS dated FROM q GROUP BY page_id)
        SELECT page_id, {_flat('name')} AS title, 'https://b.kr/view.do?id=' || item_idx AS url, agency AS unit, published FROM q JOIN g USING (page_id) WHERE page_id % 2 = 0 OR published IS NOT NULL""",
    "feed_sniff": "SELECT page_id, page_id % 3 <> 1 AND page_id % 2 = 0 AS feed FROM pages",
    "slot_scores": f"""WITH p AS (SELECT page_id, url, ({_list(SLOT_LABELS)})[1 + page_id % {len(SLOT_LABELS)}] AS label FROM pages), q AS (SELECT *, {_slot('label')} AS slot FROM p)
        SELECT page_id, label, slot, CAST({BOARD} + CASE WHEN regexp_matches(label, '공지|게시판|알림|소식|공고|뉴스|news|notice|board') THEN 6 ELSE 0 END - CASE WHEN regexp_matches(label, '자료|서식|양식|규정') THEN 3 ELSE 0 END
            - CASE WHEN regexp_matches(label, '(학과|학부|전공)$|학과 ') THEN 6 WHEN contains(label, '대학원') THEN 3 ELSE 0 END
            + CASE WHEN slot = '공지' THEN CASE WHEN label IN ('공지사항', '공지') THEN 4 ELSE 0 END - CASE WHEN regexp_matches(label, '학과|학부|전공|대학원|연구소|센터') THEN 6 ELSE 0 END ELSE 0 END AS INTEGER) AS score FROM q""",
    "links_enriched": f"""WITH {CURRENT}, e AS (SELECT src_idx, item_idx FROM c WHERE {DERIVATIVE} ORDER BY published DESC NULLS LAST, agency DESC, src_idx, item_idx LIMIT 20)
        SELECT item_idx, CAST(CASE WHEN item_idx IN (SELECT item_idx FROM e) THEN 1 ELSE 0 END AS INTEGER) AS links FROM c""",
    "web_fresh": f"""WITH {CURRENT}, v AS (SELECT org, url FROM c WHERE item_idx % 3 = 0 AND org <> 'org2') SELECT item_idx, org IN (SELECT org FROM v) AND url NOT IN (SELECT url FROM v) AS is_fresh FROM c""",
    "web_filtered": f"WITH {NOTICES_SQL} SELECT item_idx, title FROM n WHERE (published IS NULL OR published >= DATE '{NOW}' - 90) AND {canonical('category')} = '채용' AND contains(lower(title), 'th')",
    "rss_rows": f"WITH {NOTICES_SQL} SELECT CAST(item_idx AS INTEGER) AS src_idx, trim(title) AS title, url, published FROM n WHERE title <> ''",
    "datago_rows": f"""WITH {NOTICES_SQL} SELECT item_idx AS src_idx, k AS item_idx, trim(title) AS title, url, published FROM n, unnest(CASE WHEN item_idx % 2 = 0 THEN [0] ELSE [0, 1] END) AS t(k) WHERE title <> ''""",
}

_TITLE = f"regexp_replace(regexp_replace({_flat('title')}, '^(\\s*(\\[[^\\]]{{1,20}}\\]|\\([^)]{{1,20}}\\)|【[^】]{{1,20}}】))+\\s*', ''), '\\s+(새글|새 글|new|n)$', '', 'i')"
#: The scan that keeps a row unless a key of an earlier kept row of its organisation is its own.
_KEPT = f"""ks AS (SELECT *, list_filter([org || '|' || {KEY}, CASE WHEN published IS NOT NULL AND {_TITLE} <> '' THEN org || '|t' || {fold(_TITLE)} || published END], lambda x: x IS NOT NULL) AS keys,
        row_number() OVER (ORDER BY org, published DESC NULLS LAST, {canonical('category')} NOT IN ({', '.join(map(_s, rules.SPECIFIC))}), src_idx, item_idx) AS rk FROM n),
    sc AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS VARCHAR[]) AS had, false AS took UNION ALL
        SELECT sc.step + 1, CASE WHEN list_has_any(ks.keys, sc.had) THEN sc.had ELSE list_concat(sc.had, ks.keys) END, NOT list_has_any(ks.keys, sc.had) FROM sc JOIN ks ON ks.rk = sc.step + 1),
    kept AS (SELECT ks.* FROM ks JOIN sc ON sc.step = ks.rk AND sc.took)"""
_ROUTED = f"""a0 AS (SELECT CAST(event_id // 15 AS INTEGER) AS src_idx, (['보도자료', '공지', '채용'])[1 + (event_id // 5) % 3] AS category, CAST(event_id % 5 AS INTEGER) AS stage_ord,
        ({_list(rules.STAGES)})[1 + event_id % 5] AS stage, user_id % 4 <> 0 AS robots_ok, user_id % 3 <> 0 AS fetched, CAST(user_id % 5 AS INTEGER) AS n_rows FROM events),
    a1 AS (SELECT *, CAST(CASE WHEN category = '보도자료' AND stage = 'korea' THEN -1 ELSE stage_ord // 2 END AS INTEGER) AS route, robots_ok AND fetched AND n_rows > 0 AS ok FROM a0),
    a2 AS (SELECT * FROM a1 WHERE route >= 0 OR src_idx NOT IN (SELECT src_idx FROM a1 WHERE category = '보도자료' AND route >= 0 AND ok)),
    a3 AS (SELECT *, min(CASE WHEN ok THEN stage_ord END) OVER (PARTITION BY src_idx, category, route) AS winner FROM a2),
    rr AS (SELECT src_idx, category, route, coalesce(max(CASE WHEN ok THEN stage END), '') AS stage, coalesce(max(CASE WHEN ok THEN n_rows END), 0) AS n_rows, bool_or(ok) AS ok,
        string_agg(stage || ': ' || CASE WHEN ok THEN n_rows || '건' WHEN NOT robots_ok THEN 'robots' WHEN NOT fetched THEN 'fetch failed' ELSE 'no rows' END, ' → ' ORDER BY stage_ord) AS trail
        FROM a3 WHERE winner IS NULL OR stage_ord <= winner GROUP BY src_idx, category, route)"""
_SOURCES = """s0 AS (SELECT s_suppkey AS k, *, 'https://www.s' || s_suppkey || '.kr/' AS hm, (['rss', 'datago', 'k2web', 'govweb', 'govorg', 'ftp'])[1 + s_suppkey % 6] AS kind FROM supplier),
    s1 AS (SELECT k, hm, CAST(k - 1 AS INTEGER) AS src_idx, CASE WHEN k % 7 <> 0 THEN 'id' || k % 40 ELSE 'src-' || (k - 1) END AS id, trim(CASE WHEN k % 11 <> 0 THEN s_name ELSE '' END) AS name, kind,
        CASE WHEN k % 5 <> 0 THEN hm || 'list.do' ELSE '' END AS url, 'kogl_type1' AS rights, CASE WHEN k % 3 <> 0 THEN k % 4 <> 0 ELSE true END AS enabled, '복지' AS topics,
        CASE WHEN k % 2 = 0 THEN '기관' || k % 9 ELSE '' END AS org, CASE WHEN k % 9 <> 0 THEN CAST(k AS INTEGER) END AS board_id, 50 AS row, CAST(CASE WHEN k % 12 = 4 THEN 4 ELSE 0 END AS INTEGER) AS routes,
        CASE WHEN k % 24 = 10 THEN 'dept' ELSE '' END AS feed, CASE WHEN k % 8 = 4 OR k % 12 = 10 THEN hm ELSE '' END AS home, k % 4 <> 0 AS sited FROM s0),
    s AS (SELECT * FROM s1 WHERE name <> '' AND CASE kind WHEN 'ftp' THEN false WHEN 'govorg' THEN routes > 0 OR feed <> '' OR home <> '' WHEN 'k2web' THEN sited AND board_id IS NOT NULL ELSE url <> '' END)"""
for _name, _text in list(SQL.items()):
    SQL[_name] = _text.replace("{keys}", _KEPT).replace("{routed}", _ROUTED).replace("{sources}", _SOURCES).replace("{access}", SQL["access_verdicts"]).replace("{anchors}", SQL["page_anchors"])
