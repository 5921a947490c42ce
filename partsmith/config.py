"""Run parameters.  One frozen object is passed to every plan that needs them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ParseRule:
    """How a free-text description is cut into key/value items."""

    item_sep: str = ";"
    kv_sep: str = " "
    escape: str = ""
    trim: bool = True
    ignore_empty: bool = True
    strict_escape: bool = False


# Attribute names that the cleaning rules look up.
ATTR_NAME = "物资名称"
ATTR_SHORT_NAME = "物资简称"
ATTR_SPEC = "规格"
ATTR_STANDARD = "技术标准号"
ATTR_GRADE = "牌号"
ATTR_UNIT = "计量单位"
HEADER_MATERIAL_CODE = "物料代码"
DESC_HEADERS = ("全描述", "完整描述")
CATEGORY_HEADERS = ("类别", "分类")


@dataclass(frozen=True)
class Settings:
    # Defaults of the cleaning configuration.
    review_threshold: float = 60.0
    export_threshold: float = 80.0
    adaptive: bool = False
    review_percentile: float = 0.30
    export_percentile: float = 0.70
    review_clamp: tuple[float, float] = (40.0, 75.0)
    export_clamp: tuple[float, float] = (65.0, 95.0)
    adaptive_min_rows: int = 10
    recall_k: int = 10
    question_top_k: int = 15
    question_context_cap: int = 40
    similar_recall: int = 200
    similar_top: int = 10
    similar_tokens: int = 6
    callback_timeout_minutes: int = 30

    # Choices where the described behaviour and the stated intent differ.
    force_review: bool = True
    tokenise_first: bool = False
    full_fingerprint: bool = False

    rule: ParseRule = field(default_factory=ParseRule)


DEFAULTS = Settings()
