"""Model cards: the contract of a grader, checked on the driver before any job starts."""
from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

REQUIRED = ("modality", "L_m", "fs_hz", "class_order", "normalization", "training_data_hash", "model_version")
#: Kinds of heads, and the activation of each.
KINDS = {"ordinal": "softmax", "binary": "softmax", "multilabel": "sigmoid"}


class CardError(ValueError):
    """A card that breaks the contract."""


@dataclass(frozen=True)
class Head:
    name: str
    output_name: str
    kind: str
    class_order: tuple[str, ...]
    threshold: float | None = None


@dataclass(frozen=True)
class Card:
    modality: str
    length: int
    fs_hz: float
    class_order: tuple[str, ...]
    normalization: str
    model_version: str
    heads: tuple[Head, ...]
    raw: dict


def _need(ok: object, what: str) -> None:
    if not ok:
        raise CardError(what)


def head(raw: object, k: int) -> Head:
    _need(isinstance(raw, dict), f"head {k} is not an object")
    for key in ("name", "output_name"):
        _need(isinstance(raw.get(key), str) and raw[key], f"head {k} needs {key}")
    kind, order = raw.get("kind"), raw.get("class_order")
    _need(kind in KINDS, f"head {k} is of no known kind: {kind!r}")
    _need((raw.get("activation") or KINDS[kind]) == KINDS[kind], f"{kind} heads take {KINDS[kind]}")
    _need(isinstance(order, list) and order and (kind != "binary" or len(order) == 2), f"class_order of head {k}")
    t = raw.get("threshold")
    fine = isinstance(t, int | float) and not isinstance(t, bool) and 0 <= t <= 1
    _need(kind != "multilabel" or fine, f"multilabel head {k} needs a threshold in [0, 1]")
    return Head(raw["name"], raw["output_name"], kind, tuple(order), float(t) if kind == "multilabel" else None)


def load(path: str | Path) -> Card:
    """A card from its JSON file; anything that breaks the contract raises."""
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, json.JSONDecodeError) as e:
        raise CardError(f"{path}: {e}") from e
    _need(isinstance(raw, dict), "a card is an object")
    missing = [k for k in REQUIRED if k not in raw]
    _need(not missing, f"missing: {', '.join(missing)}")
    order, norm = raw["class_order"], raw["normalization"]
    _need(isinstance(raw["L_m"], int) and raw["L_m"] > 0 and float(raw["fs_hz"]) > 0, "L_m and fs_hz must be positive")
    _need(isinstance(order, list) and len(order) > 1, "class_order needs two classes")
    _need(isinstance(norm, dict) and norm.get("method") in ("none", "zscore", "minmax"), "unknown normalization")
    given = raw.get("heads", [{"name": "grade", "output_name": "q_logits", "kind": "ordinal", "class_order": order}])
    _need(isinstance(given, list) and given, "heads must be a list")
    heads = tuple(head(h, k) for k, h in enumerate(given))
    for what in ("name", "output_name"):
        _need(len({getattr(h, what) for h in heads}) == len(heads), f"two heads share their {what}")
    grades = [h for h in heads if h.kind == "ordinal"]
    _need(grades and grades[0].class_order == tuple(order), "an ordinal head must carry the card's class_order")
    return Card(raw["modality"], raw["L_m"], float(raw["fs_hz"]), tuple(order), norm["method"], raw["model_version"], heads, raw)


def verify_model(path: str | Path, card: Card) -> None:
    """The model file must have the digest that the card names, if it names one."""
    want = card.raw.get("onnx_sha256")
    _need(not want or hashlib.sha256(Path(path).read_bytes()).hexdigest() == want, "the model is not the card's")


def verify_features(card: Card, names: Sequence[str]) -> None:
    """Feature order carries meaning: it must be the card's."""
    told = (card.raw.get("feature_preprocessing") or {}).get("feature_names")
    _need(not told or list(told) == list(names), "the feature pack is not the card's")
