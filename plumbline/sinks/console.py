"""Reports as plain text for a terminal. They format rows that were collected: one document, or a batch's one-row summary."""

from __future__ import annotations

import json

from pyspark.sql import Row

from plumbline.settings import DIMENSIONS

MOST = 25


def bar(value: float, width: int = 10) -> str:
    full = round(value * width)
    return "█" * full + "·" * (width - full)


def single(row: Row, source: str = "source") -> str:
    """One document's report: score, dimensions from the highest on, what differs from the baseline if there is one, findings, warnings."""
    d = row.asDict()
    lines = [f"{d[source]}: {d['slop_score']:.1f} {d['label']}, confidence {d['confidence']:.3f}" + (f" (no label: {d['abstention_reason']})" if d["abstained"] else "")]
    lines += [f"  {bar(d[x])} {d[x]:.2f} {x}" for x in sorted(DIMENSIONS, key=lambda x: (-d[x], x))]
    if d.get("deviations"):
        lines += ["  against the baseline:", *(f"    {x['z']:+.2f} {x['dimension']}" for x in d["deviations"])]
    found = d.get("evidence") or []
    lines += [f"  {e['severity']:6} {e['rule_id']} {e['start_char']}-{e['end_char']}: {' '.join(e['span'].split())}" for e in found[:MOST]]
    if len(found) > MOST:
        lines.append(f"  and {len(found) - MOST} more")
    return "\n".join(lines + [f"  note: {w}" for w in d["warnings"]])


def batch_json(summary: Row, source: str = "source") -> str:
    """A batch's summary as JSON, keys in order."""
    d = summary.asDict(recursive=True)
    d["worst"] = [{k: x[k] for k in (source, "slop_score", "label")} for x in d["worst"]]
    return json.dumps(d, indent=2, sort_keys=True)


def batch(summary: Row, source: str = "source") -> str:
    d = summary.asDict(recursive=True)
    lines = [f"{d['n_files']} documents, mean score {d['mean_score']}, {d['n_findings']} findings"]
    lines += [f"  {k}: {n}" for k, n in sorted(d["by_label"].items())]
    return "\n".join(lines + [f"  {x['slop_score']:5.1f} {x['label']:8} {x[source]}" for x in d["worst"]])
