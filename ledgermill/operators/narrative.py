"""Sentiment, key issues and summary of analyst texts, and the risk record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.functions.replies import add_citations, parse_news_reply, source_list
from ledgermill.functions.text import contains_any, let, starts_with_any, strip
from ledgermill.operators.outlook import sector_outlook


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def _hits(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def _after(line: Column, marker: str) -> Column:
    """Text between the first and the second marker of a line."""
    return strip(F.substring_index(F.substring(line, F.instr(line, F.lit(marker)) + len(marker), F.length(line)), marker, 1))


def keyword_counts(text: Column) -> Column:
    """STRUCT(positive, negative): how many words of each list occur, every word once."""
    return let(F.lower(text), lambda t: F.struct(
        _hits(t, V.POSITIVE_WORDS).cast("bigint").alias("positive"),
        _hits(t, V.NEGATIVE_WORDS).cast("bigint").alias("negative")))


def sentiment(text: Column) -> Column:
    def declared(line: Column) -> Column:
        return let(_after(line, "sentimen:"), lambda s: F.when(F.contains(s, F.lit("negatif")), F.lit("Negatif"))
                   .when(F.contains(s, F.lit("positif")), F.lit("Positif"))
                   .when(F.contains(s, F.lit("netral")), F.lit("Netral")))

    def decide(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda line: F.contains(line, F.lit("sentimen:")))
        by_words = let(keyword_counts(t), lambda k: F.when(k["positive"] > k["negative"], F.lit("Positif"))
                       .when(k["negative"] > k["positive"], F.lit("Negatif")).otherwise(F.lit("Netral")))
        return F.coalesce(_first(F.transform(lines, declared)), by_words)
    return let(F.lower(text), decide)


def key_issues(text: Column) -> Column:
    """At most three issues: the issue section, else lines with a risk word, else the default text."""
    header = "ISU UTAMA:"

    def is_header(line: Column) -> Column:
        return F.contains(line, F.lit(header))

    def entry(line: Column) -> Column:
        numbered = F.rlike(line, F.lit(r"^[1-5]\."))
        bulleted = F.rlike(line, F.lit("^[-•*] "))
        plain = ~starts_with_any(line, ["RINGKASAN", "SENTIMEN", "ISU"]) & (F.length(line) > 10)
        rest = strip(F.substring(line, F.lit(3), F.length(line)))
        tail = _after(line, header)
        return (F.when(is_header(line), F.when((tail != "") & ~F.startswith(tail, F.lit("1.")), tail))
                .when(line == "", F.lit(None).cast("string"))
                .when(numbered | bulleted, F.when(rest != "", rest))
                .when(plain, line))

    def section(lines: Column) -> Column:
        flagged = F.transform(lines, lambda line, i: F.struct(
            i.alias("i"), is_header(line).alias("head"),
            ((line != "") & ~is_header(line) & contains_any(F.upper(line), V.ISSUE_STOP_SECTIONS)).alias("stop")))
        start = F.get(F.filter(flagged, lambda f: f["head"]), F.lit(0))["i"]

        def cut(s: Column) -> Column:
            stop = F.coalesce(F.get(F.filter(flagged, lambda f: f["stop"] & (f["i"] > s)), F.lit(0))["i"], F.size(lines))
            found = F.transform(F.slice(lines, s + 1, F.greatest(stop - s, F.lit(0))), entry)
            return F.filter(found, lambda v: v.isNotNull())
        empty = F.array().cast("array<string>")
        return F.when(start.isNotNull(), let(start, cut)).otherwise(empty)

    def decide(lines: Column) -> Column:
        risky = F.filter(lines, lambda line: (F.length(line) > 10) & (F.length(line) < 200)
                         & contains_any(F.lower(line), V.ISSUE_WORDS))
        return let(section(lines), lambda s: F.slice(
            F.when(F.size(s) > 0, s).when(F.size(risky) > 0, risky).otherwise(F.array(F.lit(V.ISSUE_DEFAULT))), 1, 3))
    return let(F.transform(F.split(text, "\n"), strip), decide)


def summary(text: Column) -> Column:
    """The summary section, else up to three meaningful sentences, else the first long line, else the default text."""
    marker = "RINGKASAN:"

    def block(lines: Column, index: Column) -> Column:
        rest = F.transform(F.slice(lines, index + 2, F.size(lines)), strip)

        def until_stop(ls: Column) -> Column:
            ends = F.filter(F.transform(ls, lambda line, i: F.struct(i.alias("i"), (
                (line == "") | starts_with_any(line, ["SENTIMEN:", "ISU UTAMA:"])).alias("stop"))), lambda e: e["stop"])
            return F.slice(ls, F.lit(1), F.coalesce(F.get(ends, F.lit(0))["i"], F.size(ls)))
        joined = F.array_join(let(rest, until_stop), " ")
        return F.when(joined != "", joined)

    def declared(lines: Column) -> Column:
        return _first(F.transform(lines, lambda line, i: F.when(
            F.contains(line, F.lit(marker)),
            let(_after(line, marker), lambda s: F.when(s != "", s).otherwise(block(lines, i))))))

    def fallback(clean: Column) -> Column:
        plain = clean
        for pattern in V.INTRO_PATTERNS:
            plain = F.regexp_replace(plain, f"(?isU){pattern}", "")

        def choose(t: Column) -> Column:
            sentences = F.slice(F.filter(
                F.transform(F.split(t, "[.!?]+"), strip),
                lambda s: (F.length(s) > 20) & ~starts_with_any(F.lower(s), V.SENTENCE_INTROS)
                & ~F.rlike(s, F.lit(r"^\*\*\[\d+\]\*\*\s*"))), 1, 3)
            long_line = F.get(F.filter(
                F.transform(F.split(t, "\n"), strip),
                lambda s: (F.length(s) > 20) & ~starts_with_any(F.lower(s), V.LINE_INTROS)), F.lit(0))
            return let(sentences, lambda s: F.when(F.size(s) > 0, F.concat(F.array_join(s, ". "), F.lit("."))).otherwise(
                F.coalesce(long_line, F.lit(V.SUMMARY_DEFAULT))))
        return let(plain, choose)
    return let(F.regexp_replace(text, r"\*\*\[\d+\]\*\*", ""), lambda clean: F.coalesce(
        let(F.split(clean, "\n"), declared), fallback(clean)))


def risk_records(texts: DataFrame, outlook: DataFrame, now: Column | None = None) -> DataFrame:
    """Analyst texts (applicant, industry_main, industry_sub, text, chunks, supports) to risk records."""
    chunks = F.coalesce(F.size("chunks"), F.lit(0))
    chunks = F.when(chunks < 0, 0).otherwise(chunks)
    rated = sector_outlook(texts, outlook)
    return rated.select(
        F.col("applicant").alias("applicantName"),
        add_citations(summary(F.col("text")), F.col("supports"), chunks).alias("groundedSummary"),
        sentiment(F.col("text")).alias("overallSentiment"), key_issues(F.col("text")).alias("keyIssues"),
        F.coalesce(source_list(F.col("chunks")), F.array().cast("array<struct<no:string,title:string,url:string>>"))
        .alias("supportingSources"),
        F.col("outlook").alias("industrySectorOutlook"),
        (F.current_timestamp() if now is None else now).alias("lastUpdateTimestamp"))


def risk_records_from_replies(answers: DataFrame, outlook: DataFrame, now: Column | None = None) -> DataFrame:
    """Risk records of applicants (applicant, industry_main, industry_sub, reply) whose news come as a JSON reply. An
    unreadable reply gives the sentiment 'Error' and empty lists."""
    rated = sector_outlook(answers, outlook).withColumn("news", parse_news_reply(F.col("reply")))
    failed = F.col("news").isNull()
    return rated.select(
        F.col("applicant").alias("applicantName"),
        F.when(failed, F.lit("Gagal menghasilkan analisis AI.")).otherwise(F.col("news.summary")).alias("groundedSummary"),
        F.when(failed, F.lit("Error")).otherwise(F.col("news.sentiment")).alias("overallSentiment"),
        F.coalesce("news.key_issues", F.array().cast("array<string>")).alias("keyIssues"),
        F.coalesce("news.sources", F.array().cast("array<struct<title:string,url:string>>")).alias("supportingSources"),
        F.col("outlook").alias("industrySectorOutlook"),
        (F.current_timestamp() if now is None else now).alias("lastUpdateTimestamp"))


def news_view(records: DataFrame) -> DataFrame:
    return records.select("applicantName", "groundedSummary", "overallSentiment", "keyIssues", "supportingSources",
                          "lastUpdateTimestamp")


def outlook_view(records: DataFrame) -> DataFrame:
    return records.select("applicantName", "industrySectorOutlook", "lastUpdateTimestamp")
