"""The report of a run as one text: every table of the evaluation becomes lines with a place, and the places their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import written

#: The report's texts.
TITLE = "# Оценка прогона `{label}`\n"
FACTS = [("set", "- Набор: `{}`"), ("app_version", "- Версия приложения: {}"), ("git_commit", "- Git commit: `{}`"), ("created_at", "- Записан: {}")]
WARNING = "\n> ⚠ Прогон неполный: {}"
HIT = ["\n## Hit (найденные шорты)\n", "| Эпизод | Найдено | Всего | Доля |", "|---|---|---|---|"]
MISSING = ["\n### Шорты, которые не найдены\n", "| Эпизод | Шорт | Лучшее покрытие |", "|---|---|---|"]
HOOK = ["\n## Hook (начало найденного клипа)\n", "| Эпизод | Шорт | В пределах ±hook-sec начала | В пределах ±hook-sec `source_span[0]` (для reordered) |", "|---|---|---|---|"]
PRECISION = ["\n## Precision (доля клипов, которые что-то нашли)\n"]
PRECISE = "%s из %s клипов (%s) находят шорт или совпадают с оценкой keep/edit."
LABELS = ["\n## Оценки (Labels)\n", "| Эпизод | Совпали с reject (ошибки) | Совпали с keep (хорошие) | Совпали с edit |", "|---|---|---|---|"]
EPISODES = ["\n## По эпизодам\n", "| Эпизод | Клипов | Медиана длительности | keep | edit | reject | pending | keep среди оценённых |", "|---|---|---|---|---|---|---|---|"]
AGAINST = "\n## Сравнение с прогоном `{}`\n"
CHANGES = ["| Метрика | {} | {} | Δ |", "|---|---|---|---|"]
COVERAGE = ["\n| Эпизод | Шорт | Покрытие до | Покрытие после |", "|---|---|---|---|"]
TOTAL, YES, NO, NONE, POINTS = "Всего", "да", "нет", "—", " п.п."
HIT_ROW, PRECISION_ROW, CLIPS_ROW = "Hit (найдено/всего)", "Precision", "Всего клипов"


def _percent(part: str, whole: str) -> Column:
    """Whole per cent, halves to even; a dash of nothing."""
    share = F.bround(F.lit(100.0) * F.col(part) / F.nullif(F.col(whole), F.lit(0)), 0).cast("int").cast("string")
    return F.coalesce(F.concat(share, F.lit("%")), F.lit(NONE))


def _row(*cells: Column | str) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cells]), F.lit(" |"))


def _share(pm: str) -> Column:
    """Thousandths as a number with two places."""
    return F.format_string("%d.%02d", F.floor((F.col(pm) + 5) / 1000), F.floor((F.col(pm) + 5) / 10) % 100)


def _signed(change: Column) -> Column:
    return F.concat(F.when(change >= 0, "+").otherwise(""), change.cast("string"))


class _Lines:
    """Lines with a section and, in it, a place: numbers first, then names."""

    def __init__(self, spark: SparkSession):
        self.spark, self.section, self.parts = spark, 0, []

    def fixed(self, lines: list[str], below: DataFrame | None = None) -> None:
        """Lines as they stand; if below is given, only where it has rows."""
        self.section += 1
        rows = self.spark.createDataFrame([(self.section, k, 0, 0, line) for k, line in enumerate(lines)], "section int, a long, b long, c long, line string")
        if below is not None:  # at most one row decides
            some = below.limit(1).groupBy().agg(F.count(F.lit(1)).alias("_n")).select(F.explode(F.when(F.col("_n") > 0, F.array(F.lit(self.section)))).alias("section"))
            rows = rows.join(F.broadcast(some), "section", "left_semi")
        self.parts.append(rows)

    def table(self, rows: DataFrame, line: Column, *place: Column) -> None:
        self.section += 1
        a, b, c = [*place, *[F.lit(0)] * 3][:3]
        self.parts.append(rows.select(F.lit(self.section).alias("section"), a.cast("long").alias("a"), b.cast("long").alias("b"), c.cast("long").alias("c"), line.alias("line")))

    def text(self) -> DataFrame:
        whole = reduce(DataFrame.unionByName, self.parts)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("section", "a", "b", "c", "line"))), lambda x: x["line"])
        return whole.groupBy().agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("report"))


def render_report(run: dict, metrics: DataFrame, missing: DataFrame, hooks: DataFrame, labels: DataFrame, medians: DataFrame, reviews: DataFrame, warnings: list[str] = (), against: tuple[str, DataFrame, DataFrame] | None = None, key: str = "video_id") -> DataFrame:
    """One row with the report of a run.

    run: label, set, app_version, git_commit, created_at. metrics, missing, hooks, labels: of the evaluation (metrics with
    the total under a null key; missing: missing_shorts; labels: label_matches). medians (key, median_ms); reviews (key,
    keep, edit, reject, pending). against: the other run's label, compare_metrics and compare_runs.
    Episodes come in order of key; coverages are rounded from thousandths that were rounded down. Tables that several
    sections read are written to the shared folder first."""
    metrics, missing, hooks, labels = (written(t) for t in (metrics, missing, hooks, labels))
    out, k = _Lines(metrics.sparkSession), F.col(key)
    out.fixed([TITLE.format(label=run["label"]), *[line.format(run.get(name)) for name, line in FACTS if name != "git_commit" or run.get(name)], *[WARNING.format(w) for w in warnings], *HIT])
    of_episode, total = metrics.where(k.isNotNull()), metrics.where(k.isNull())
    out.table(of_episode, _row(key, "hits", "shorts", _percent("hits", "shorts")), k)
    bold = lambda c: F.concat(F.lit("**"), c.cast("string"), F.lit("**"))
    out.table(total, _row(bold(F.lit(TOTAL)), bold(F.col("hits")), bold(F.col("shorts")), bold(_percent("hits", "shorts"))))
    out.fixed(MISSING, missing)
    out.table(missing, _row(key, "short_no", _share("covered_pm")), F.col("covered_pm"), k, F.col("short_no"))
    out.fixed(HOOK, hooks)
    said = lambda c: F.when(F.col(c), YES).otherwise(NO)
    out.table(hooks, _row(key, "short_no", said("hook_ok"), F.when(F.col("reordered"), said("span_ok")).otherwise(NONE)), k, F.col("short_no"))
    out.fixed(PRECISION)
    out.table(total, F.format_string(PRECISE, F.col("precise").cast("string"), F.col("clips").cast("string"), _percent("precise", "clips")))
    out.fixed(LABELS, labels)
    ids = lambda label: F.array_sort(F.collect_set(F.when(F.col("label") == label, F.col("clip_no"))))
    lists = labels.groupBy(key).agg(*[ids(x).alias(x) for x in ("reject", "keep", "edit")])
    cell = lambda c: F.when(F.size(c) == 0, NONE).otherwise(F.concat(F.size(c), F.lit(": "), F.array_join(F.transform(c, lambda x: x.cast("string")), ", ")))
    out.table(lists, _row(key, cell("reject"), cell("keep"), cell("edit")), k)
    out.fixed(EPISODES)
    kinds = ["keep", "edit", "reject", "pending"]
    per = of_episode.select(key, "clips").join(medians.select(key, "median_ms").hint("merge"), key, "left").join(reviews.select(key, *kinds).hint("merge"), key, "left").na.fill(0, kinds)
    per = per.withColumn("rated", F.col("keep") + F.col("edit") + F.col("reject"))
    length = F.coalesce(F.concat(F.bround(F.col("median_ms") / 1000, 1).cast("decimal(18,1)").cast("string"), F.lit("s")), F.lit(NONE))
    out.table(per, _row(key, "clips", length, *kinds, _percent("keep", "rated")), k)
    if against:
        label, changes, shorts = against[0], written(against[1]), against[2]
        out.fixed([AGAINST.format(label), *[x.format(label, run["label"]) for x in CHANGES]])
        whole = changes.where(k.isNull())
        of = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"))
        exact = lambda side: F.lit(100.0) * F.col(f"precise_{side}") / F.nullif(F.col(f"clips_{side}"), F.lit(0))
        points = F.coalesce(F.concat(_signed(F.bround(exact("after") - exact("before"), 0).cast("int")), F.lit(POINTS)), F.lit(NONE))
        out.table(whole, _row(F.lit(HIT_ROW), of("hits_before", "shorts_before"), of("hits_after", "shorts_after"), _signed(F.col("hits_change"))))
        out.table(whole, _row(F.lit(PRECISION_ROW), _percent("precise_before", "clips_before"), _percent("precise_after", "clips_after"), points))
        out.table(whole, _row(F.lit(CLIPS_ROW), "clips_before", "clips_after", _signed(F.col("clips_change"))))
        out.fixed(COVERAGE)
        out.table(shorts, _row(key, "short_no", _share("before_pm"), _share("after_pm")), k, F.col("short_no"))
    return out.text()
