"""Every ranking parameter in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RankingConfig:
    """Fixed values are the field weights, alpha, beta, gamma and the diversity window; the rest are choices made here."""

    field_weights: dict[str, float] = field(default_factory=lambda: {"title": 4.0, "anchor": 3.0, "attachment": 1.5, "body": 1.0})
    alpha: float = 0.5
    beta: float = 0.1
    gamma: float = 0.3
    diversity_window: int = 60
    per_host: int = 3
    signature_chars: int = 200
    idf_mode: str = "smooth"  # or "ltc"
    damping: float = 0.85
    iterations: int = 10
    fresh_days: float = 180.0
    intent_boost: float = 0.2
    phrase_boost: float = 0.3
    coverage_boost: float = 0.2
    title_boost: float = 0.2
    low_quality_factor: float = 0.3
    list_page_factor: float = 0.7
    interest_share: float = 0.4
    role_share: float = 0.3
    click_share: float = 0.3
    snippet_chars: int = 160
    nav_chars: int = 120
    nav_penalty: int = 2
    recall: int = 1000
    #: Document types that students and teachers prefer.
    student_types: tuple[str, ...] = ("html",)
    teacher_types: tuple[str, ...] = ("pdf", "doc", "docx", "xls", "xlsx")
    #: Query words that stand for a topic, and words of a document on that topic.
    intents: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {"employment": ("job", "career", "就业", "招聘"), "academic": ("course", "exam", "选课", "教务"), "admission": ("admission", "招生"), "library": ("library", "图书馆"), "research": ("research", "科研")}
    )


DEFAULT = RankingConfig()
STUDENTS = ("undergraduate", "graduate")
ROLES = ("undergraduate", "graduate", "teacher", "alumnus", "guest")
