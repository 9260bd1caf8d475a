"""The report's whole text against a fixture written by hand."""

from __future__ import annotations

from lectern.operators import report as R

WANT = """# Оценка прогона `b`

- Набор: `set1`
- Версия приложения: 1.2
- Записан: 2026-01-01

> ⚠ Прогон неполный: one failed

## Hit (найденные шорты)

| Эпизод | Найдено | Всего | Доля |
|---|---|---|---|
| 1 | 1 | 2 | 50% |
| 2 | 0 | 0 | — |
| 10 | 0 | 1 | 0% |
| **Всего** | **1** | **3** | **33%** |

### Шорты, которые не найдены

| Эпизод | Шорт | Лучшее покрытие |
|---|---|---|
| 10 | 0 | 0.00 |
| 1 | 1 | 0.70 |

## Hook (начало найденного клипа)

| Эпизод | Шорт | В пределах ±hook-sec начала | В пределах ±hook-sec `source_span[0]` (для reordered) |
|---|---|---|---|
| 1 | 0 | да | нет |

## Precision (доля клипов, которые что-то нашли)

2 из 4 клипов (50%) находят шорт или совпадают с оценкой keep/edit.

## Оценки (Labels)

| Эпизод | Совпали с reject (ошибки) | Совпали с keep (хорошие) | Совпали с edit |
|---|---|---|---|
| 1 | — | 2: 2, 10 | 1: 3 |

## По эпизодам

| Эпизод | Клипов | Медиана длительности | keep | edit | reject | pending | keep среди оценённых |
|---|---|---|---|---|---|---|---|
| 1 | 3 | 45.2s | 1 | 1 | 0 | 2 | 50% |
| 2 | 0 | — | 0 | 0 | 0 | 0 | — |
| 10 | 1 | 60.0s | 0 | 0 | 0 | 1 | — |

## Сравнение с прогоном `a`

| Метрика | a | b | Δ |
|---|---|---|---|
| Hit (найдено/всего) | 2/3 | 1/3 | -1 |
| Precision | 25% | 50% | +25 п.п. |
| Всего клипов | 4 | 4 | +0 |

| Эпизод | Шорт | Покрытие до | Покрытие после |
|---|---|---|---|
| 1 | 0 | 0.85 | 1.00 |
| 10 | 0 | 0.00 | 0.00 |
"""


def test_report(spark):
    make = spark.createDataFrame
    metrics = make([(1, 2, 1, 3, 2), (10, 1, 0, 1, 0), (2, 0, 0, 0, 0), (None, 3, 1, 4, 2)], "video_id long, shorts long, hits long, clips long, precise long")
    missing = make([(1, 1, 699, 1), (10, 0, 0, 1)], "video_id long, short_no long, covered_pm long, rank int")
    hooks = make([(1, 0, 5, True, False, True)], "video_id long, short_no long, clip_no long, hook_ok boolean, span_ok boolean, reordered boolean")
    labels = make([(1, 10, "keep", 900), (1, 2, "keep", 600), (1, 3, "edit", 700)], "video_id long, clip_no long, label string, iou_pm long")
    medians = make([(1, 45_240.0), (10, 60_000.0)], "video_id long, median_ms double")
    reviews = make([(1, 1, 1, 0, 2), (10, 0, 0, 0, 1)], "video_id long, keep long, edit long, reject long, pending long")
    changes = make([(None, 2, 1, 3, 3, 1, 2, 4, 4, -1, 0)], "video_id long, hits_before long, hits_after long, shorts_before long, shorts_after long, precise_before long, precise_after long, clips_before long, clips_after long, hits_change long, clips_change long")
    shorts = make([(1, 0, 850, 1000), (10, 0, 4, 0)], "video_id long, short_no long, before_pm long, after_pm long")
    run = {"label": "b", "set": "set1", "app_version": "1.2", "git_commit": None, "created_at": "2026-01-01"}
    got = R.render_report(run, metrics, missing, hooks, labels, medians, reviews, ["one failed"], ("a", changes, shorts)).first()[0]
    assert got == WANT
    bare = R.render_report(run, metrics, missing.limit(0), hooks.limit(0), labels.limit(0), medians, reviews).first()[0]
    assert "не найдены" not in bare and "## Hook" not in bare and "Labels" not in bare and bare.endswith("| — |\n")
