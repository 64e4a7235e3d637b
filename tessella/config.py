"""Defaults of the panel jobs, as plain values that every operator takes as arguments."""

from __future__ import annotations

from dataclasses import dataclass

#: Codes that stand for missing numbers.
SENTINELS = (-99999999.0, -77777777.0)
#: Units name a value type by the first of these words that they hold; in Russian, then in English.
VALUE_TYPES = (
    ("к предыдущему году", "rate_yoy"),
    ("к декабрю", "rate_yoy"),
    ("в процентах к итогу", "share"),
    ("в процентах от", "share"),
    ("в процентах", "share"),
    ("процентов", "share"),
    ("удельный вес", "share"),
    ("индекс", "index"),
    ("число лет", "index"),
    ("на 1 женщину", "index"),
    ("на душу", "per_capita"),
    ("на 1000 человек", "per_capita"),
    ("на 10000 человек", "per_capita"),
    ("на 100000 человек", "per_capita"),
    ("на 100 000 человек", "per_capita"),
    ("рублей в месяц", "per_capita"),
    ("в месяц, рублей", "per_capita"),
    ("на потребителя", "per_capita"),
    ("на 100 домохозяйств", "per_capita"),
    ("на 1 работника", "per_capita"),
    ("на 1000 детей", "per_capita"),
    ("км2 территории", "rate"),
    ("на 1000 браков", "rate"),
    ("на 1000 мужчин", "index"),
    ("на один рубль", "index"),
    ("per 1000", "rate"),
    ("per capita", "per_capita"),
    ("percent", "share"),
    ("share", "share"),
    ("index", "index"),
    ("thousand", "absolute"),
    ("units", "absolute"),
)


@dataclass(frozen=True)
class PanelConfig:
    """Window, gates and thresholds."""

    max_gap: int = 2
    share_max: float = 0.15
    coverage: float = 0.8
    min_entities: int = 5
    min_years: int = 3
    leap_gap: int = 2
    volatile_changes: int = 3
    max_break_ratio: float = 0.5
    min_len: int = 8
