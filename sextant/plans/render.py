"""The files of a run: YAML documents, a signal card, and a page with charts; and the page of a family of runs."""

from __future__ import annotations

import html
import statistics
from dataclasses import asdict, is_dataclass
from pathlib import Path
from typing import Any

import yaml

ROWS = ("n", "corr", "rank_corr", "directional_accuracy", "mae", "mape", "rmse")


def plain(x: Any) -> Any:
    """Numbers, texts, lists and maps only, for YAML."""
    if is_dataclass(x):
        x = asdict(x)
    if isinstance(x, dict):
        return {str(k) if not isinstance(k, int) else k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if hasattr(x, "item"):
        return x.item()
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def save_yaml(path: Path, doc: Any) -> None:
    path.write_text(yaml.safe_dump(plain(doc), sort_keys=False, allow_unicode=True))


def card(spec, s) -> str:
    """The signal card, in Markdown."""
    show = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [f"# {spec.signal_name}", "", f"**Confidence cap:** {s.gate['confidence_cap']} ({s.gate['binding_constraint']})  ", f"**Relationship:** {s.relationship[0]}: {s.relationship[1]}", "", "## Hypothesis", "", str(spec.hypothesis.get("statement", "none given")).strip(), "", "## Best feature", "", f"`{s.best_feature}`, {s.search['features_tested']} tested", ""]
    lines += ["| metric | train | test |", "|---|---|---|", *(f"| {k} | {show(s.train.get(k))} | {show(s.test.get(k))} |" for k in ROWS), "", f"Out of sample: {'holds' if s.survives_oos else 'does not hold'}; {show(s.oos_degradation_pct)} % lost.", ""]
    lines += ["## Lead and lag", "", *(f"- {k}: {show(v)}" for k, v in sorted(s.lead_lag.items())), "", "## Checks", "", "| check | verdict | value | |", "|---|---|---|---|", *(f"| {c.name} | {c.verdict} | {show(c.value)} | {c.explanation} |" for c in s.checks), ""]
    return "\n".join([*lines, "## What to do", "", *(f"- {a}" for a in s.recommendations or ["nothing stands against it"]), ""])


def _line(values: list[float], width: int, height: int, colour: str) -> str:
    if len(values) < 2:
        return ""
    low, high = min(values), max(values)
    at = " ".join(f"{k * width / (len(values) - 1):.1f},{height - (v - low) / ((high - low) or 1) * height:.1f}" for k, v in enumerate(values))
    return f'<polyline fill="none" stroke="{colour}" points="{at}"/>'


def overlay(pairs: list[tuple]) -> str:
    """Both series, each in its own deviations."""
    out = []
    for k, colour in ((1, "#1f77b4"), (2, "#d62728")):
        v = [x[k] for x in pairs if x[1] is not None and x[2] is not None]
        sd = statistics.pstdev(v) if len(v) > 1 else 0
        out.append(_line([(x - statistics.fmean(v)) / sd for x in v] if sd else [], 600, 160, colour))
    return f'<svg viewBox="0 0 600 160" width="600">{"".join(out)}</svg>'


def bars(profile: dict[int, float | None]) -> str:
    boxes = []
    for n, (_, v) in enumerate(sorted(profile.items())):
        h = abs(v or 0) * 60
        boxes.append(f'<rect x="{n * 40 + 5}" y="{60 - h if (v or 0) > 0 else 60:.1f}" width="30" height="{h:.1f}" fill="#1f77b4"/>')
    return f'<svg viewBox="0 0 {40 * max(1, len(profile))} 120" width="400">{"".join(boxes)}</svg>'


def strip(cap: str) -> str:
    return "".join(f'<span class="tier{" on" if t == cap else ""}">{t}</span>' for t in ("low", "medium", "high"))


STYLE = "<style>body{font:15px sans-serif;max-width:60em;margin:2em auto}td,th{padding:2px 8px;text-align:left}.tier{padding:2px 10px;background:#eee}.on{background:#fc6}</style>"


def page(spec, s, pairs: list[tuple]) -> str:
    e = lambda x: html.escape(str(x))
    rows = "".join(f"<tr><td>{e(c.name)}</td><td>{e(c.verdict)}</td><td>{e(c.explanation)}</td></tr>" for c in s.checks)
    return f"<!DOCTYPE html><meta charset=utf-8><title>{e(spec.signal_name)}</title>{STYLE}<h1>{e(spec.signal_name)}</h1><p>{strip(s.gate['confidence_cap'])}</p><p>{e(s.relationship[0])}: {e(s.relationship[1])}</p>{overlay(pairs)}<h2>Lead and lag</h2>{bars(s.lead_lag)}<h2>Checks</h2><table>{rows}</table>"


def write_run(folder: Path, spec, s, commit: str | None, pairs: list[tuple]) -> None:
    """run, cadence-rollup-audit, feature-grid, feature-search-log, backtest-result, validation-report (YAML), signal-card.md, dashboard.html."""
    folder.mkdir(parents=True, exist_ok=True)
    docs = {
        "run": {"signal_id": s.signal_id, "registry_commit": commit, "spec": spec},
        "cadence-rollup-audit": s.audits,
        "feature-grid": [{k: f[k] for k in ("feature_id", "r_train", "n_train", "r_test", "n_test", "rank")} for f in s.features],
        "feature-search-log": s.search,
        "backtest-result": {"best_feature": s.best_feature, "train": s.train, "test": s.test, "lead_lag_profile": [{"lag": k, "corr": v} for k, v in sorted(s.lead_lag.items())], "oos_degradation_pct": s.oos_degradation_pct, "survives_oos": s.survives_oos},
        "validation-report": {"signal_id": s.signal_id, "checks": s.checks, "relationship_type": s.relationship[0], "justification": s.relationship[1], **s.gate, "recommendations": s.recommendations},
    }
    for name, doc in docs.items():
        save_yaml(folder / f"{name}.yaml", doc)
    (folder / "signal-card.md").write_text(card(spec, s))
    if spec.outputs.get("dashboard", True):
        (folder / "dashboard.html").write_text(page(spec, s, pairs))


def missing_files(folder: Path) -> list[str]:
    """What a run's folder lacks."""
    names = [f"{n}.yaml" for n in ("run", "cadence-rollup-audit", "feature-grid", "feature-search-log", "backtest-result", "validation-report")] + ["signal-card.md"]
    return [n for n in names if not (folder / n).exists()]


def family_page(folders: list[Path], title: str = "Signals") -> str:
    """One page for several runs: tiers, kinds, the worst tier, and which agree in sign."""
    found = []
    for folder in folders:
        for name in ("validation-report.yaml", "backtest-result.yaml"):
            if not (folder / name).exists():
                raise FileNotFoundError(folder / name)
        found.append((yaml.safe_load((folder / "validation-report.yaml").read_text()), yaml.safe_load((folder / "backtest-result.yaml").read_text())))
    order = ("low", "medium", "high")
    worst = min((v["confidence_cap"] for v, _ in found), key=order.index, default="none")
    rows = "".join(f"<tr><td>{html.escape(v['signal_id'])}</td><td>{v['confidence_cap']}</td><td>{v['relationship_type']}</td><td>{b['test'].get('corr')}</td></tr>" for v, b in found)
    agree = [(a["signal_id"], c["signal_id"], (b["test"].get("corr") or 0) * (d["test"].get("corr") or 0) >= 0) for n, (a, b) in enumerate(found) for c, d in found[n + 1 :]]
    pairs = "".join(f"<li>{html.escape(a)} and {html.escape(c)} {'agree' if ok else 'contradict each other'}</li>" for a, c, ok in agree)
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title>{STYLE}<h1>{html.escape(title)}</h1><p>Weakest: {strip(worst)}</p><table>{rows}</table><ul>{pairs}</ul>"
