"""Lines of text made from counters, for people who read results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording that clients show.
CITED_ALL = "인용 전건이 검색 결과에 존재 — 의미 일치는 화면에서 직접 확인"
CITED_SOME = "인용 %d건 중 %d건이 검색 결과에 존재 (일부 탈락)"
CITED_NONE = "1층만 표시 중 (인용 없음)"
CITED_NOT_YET = "1층만 표시 중 (인용 검증 대기)"
SHOWN_SOME = "검색 결과 %d개 중 %d개 표시 중 — %s 권장"
SHOWN_HINTS = {True: "필터 해제", False: "그래프 새로고침"}
RESTORED_EACH = "'%s'는 그래프에 없어, 이 호출의 question에서 자모 1개만 다른 '%s'로 다시 검색함"
RESTORED_ALL = "키워드 자동 재검색 %d건: %s (자동 추정 — 확정된 오타 판정이 아니다)"
RESTORED_ADVICE = "답변 본문에 이 재검색 사실을 밝혀라 — 추출한 키워드가 질문 표기와 달라 질문 쪽 표기로 다시 검색했다. 사용자가 실제로 쓴 표기와 다르면 그렇게 지적하라."


def citation_phrase(status: Column, submitted: Column, accepted: Column) -> Column:
    """What is said of a search's citations; no status yet is its own case."""
    return (
        F.when(status == "verified", CITED_ALL).when(status == "partial", F.format_string(CITED_SOME, submitted, accepted))
        .when(status == "none", CITED_NONE).otherwise(CITED_NOT_YET)
    )


def coverage_notice(total: Column, matched: Column, filtered: Column) -> Column:
    """A hint where less is shown than was found; null where all is, or nothing was found."""
    hint = F.when(filtered, SHOWN_HINTS[True]).otherwise(SHOWN_HINTS[False])
    return F.when((total > 0) & (matched < total), F.format_string(SHOWN_SOME, total, matched, hint))


def restoration_lines(seeds: Column) -> Column:
    """Lines on repaired keywords of ``seeds``, an array of (keyword, restored_from, n_matched); none where no repair found anything."""
    used = F.filter(seeds, lambda s: s["restored_from"].isNotNull() & (s["restored_from"] != "") & (s["n_matched"] > 0))
    each = F.transform(used, lambda s: F.format_string(RESTORED_EACH, s["restored_from"], s["keyword"]))
    first = F.format_string(RESTORED_ALL, F.size(used), F.array_join(each, " / "))
    return F.when(F.size(used) > 0, F.array(first, F.lit(RESTORED_ADVICE))).otherwise(F.array().cast("array<string>"))
