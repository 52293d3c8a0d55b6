"""HTML reports from small collected tables; nothing is opened."""

from __future__ import annotations

import functools
import html
import logging
import time

log = logging.getLogger(__name__)
_STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px 8px;text-align:left}"


def timed(name: str):
    """Logs how long a stage takes and keeps it in ``<result>['seconds']`` where the result is a dictionary."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            began = time.time()
            out = f(*args, **kwargs)
            log.info("%s took %.1f s", name, time.time() - began)
            if isinstance(out, dict):
                out["seconds"] = round(time.time() - began, 3)
            return out

        return run

    return wrap


def table_html(rows: list[dict]) -> str:
    if not rows:
        return "<p>none</p>"
    names = list(rows[0])
    cell = lambda x: html.escape(f"{x:.4g}" if isinstance(x, float) else str(x))
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(r.get(n))}</td>" for n in names) + "</tr>" for r in rows) + "</table>"


def page(title: str, sections: dict[str, list[dict] | str]) -> str:
    body = "".join(f"<h2>{html.escape(k)}</h2>{v if isinstance(v, str) else table_html(v)}" for k, v in sections.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{_STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def reduction_report(before: list[dict], after: list[dict], drops: dict[str, dict[str, str]], hidden=("biospecimen",)) -> str:
    rows = [{"table": t, "dropped": len(r), "reasons": ", ".join(sorted(set(r.values())))} for t, r in drops.items() if t.split(".")[0] not in hidden]
    return page("Data reduction", {"Before": before, "After": after, "Dropped columns": rows})


def engineering_report(summary: dict) -> str:
    return page("Feature engineering", {"Totals": [{"columns": summary["columns"], "new_features": summary["new_features"]}], "Steps": [{"step": s["step"], "added": s["added"], "names": ", ".join(s["names"])} for s in summary["steps"]]})


def selection_report(candidates: int, selected: list[str], method: str) -> str:
    return page("Feature selection", {"Method": [{"method": method, "candidates": candidates, "selected": len(selected)}], "Selected": [{"feature": c} for c in selected]})


def recommendations(accuracy: float, reduction_pct: float, n_classes: int) -> list[str]:
    out = []
    if accuracy < 0.7:
        out.append("Accuracy is below 0.7: try more features, tuning or an ensemble.")
    if reduction_pct > 80:
        out.append("More than 80 % of the columns were removed: review the drop thresholds.")
    if n_classes > 5:
        out.append("There are more than five classes: consider merging some.")
    return out or ["No remarks."]


def class_metrics(confusion: list[dict], labels: list[str]) -> list[dict]:
    """Precision, recall, F1 and rows of each class, from rows (label, prediction, n) of class numbers."""
    out = []
    for k, name in enumerate(labels):
        hit = sum(r["n"] for r in confusion if r["label"] == r["prediction"] == k)
        own, said = (sum(r["n"] for r in confusion if r[side] == k) for side in ("label", "prediction"))
        precision, recall = hit / said if said else 0.0, hit / own if own else 0.0
        out.append({"class": name, "precision": precision, "recall": recall, "F1": 2 * precision * recall / (precision + recall) if hit else 0.0, "rows": own})
    return out


def classification_report(leaderboard: list[dict], test: dict, importance: list, classes: list[dict], confusion: list[dict], notes: list[str], data: dict | None = None, tuned: dict | None = None, labels: list[str] | None = None, plots: list[str] = ()) -> str:
    named = [r | {"label": labels[int(r["label"])], "prediction": labels[int(r["prediction"])]} for r in confusion] if labels else confusion
    return page(
        "Classification",
        {
            "Data": [data] if data else [],
            "Class distribution": classes,
            "Leaderboard (cross-validation)": leaderboard,
            "Best model": leaderboard[:1],
            "Tuning": [tuned] if tuned else [],
            "Test split": [test],
            "Metrics by class": class_metrics(confusion, labels) if labels else [],
            "Confusion": named,
            "Feature importance": [{"feature": f, "importance": w} for f, w in importance],
            "Data of plots": [{"table": f"plots/{name}"} for name in plots],
            "Recommendations": [{"note": n} for n in notes],
        },
    )


def summary_report(stages: list[dict]) -> str:
    return page("Pipeline summary", {"Stages": stages})
