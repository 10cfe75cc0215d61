"""The layers of the graph, their order, and running them (ETL-19)."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

#: layer -> layers that it needs
NEEDS: dict[str, tuple[str, ...]] = {
    "physical": (),
    "service_schedule": ("physical",),
    "fare": ("physical",),
    "interruption": ("physical", "service_schedule", "fare"),
    "accessibility": ("physical", "service_schedule", "fare"),
}


def closure(wanted: Iterable[str], edges: dict[str, tuple[str, ...]]) -> set[str]:
    out, todo = set(), list(wanted)
    while todo:
        layer = todo.pop()
        if layer not in edges:
            raise ValueError(f"no layer {layer}; there are {', '.join(edges)}")
        if layer not in out:
            out.add(layer)
            todo += edges[layer]
    return out


def plan(wanted: Iterable[str], mode: str = "isolated", needs: dict[str, tuple[str, ...]] = NEEDS) -> list[str]:
    """The layers to run, each after those it needs: only those named
    ('isolated'), with what they need ('deps'), or with what needs them
    ('cascade')."""
    wanted = list(wanted)
    backward = {x: tuple(y for y in needs if x in needs[y]) for x in needs}
    chosen = {"isolated": lambda: closure(wanted, dict.fromkeys(needs, ())), "deps": lambda: closure(wanted, needs), "cascade": lambda: closure(wanted, backward)}[mode]()
    sorter = TopologicalSorter({x: [y for y in needs[x] if y in chosen] for x in needs if x in chosen})
    try:
        return list(sorter.static_order())
    except CycleError as e:
        raise ValueError(f"layers need each other: {' -> '.join(e.args[1])}") from e


@dataclass
class Outcome:
    layer: str
    ok: bool
    message: str = ""


def run(layers: list[str], steps: dict[str, Callable[[], None]], dry: bool = False) -> list[Outcome]:
    """Run the steps in order; the first that fails ends the run."""
    out = []
    for layer in layers:
        if dry:
            out.append(Outcome(layer, True, "planned"))
            continue
        try:
            steps[layer]()
        except Exception as e:  # whatever a layer raises stops those after it
            out.append(Outcome(layer, False, str(e)))
            break
        out.append(Outcome(layer, True))
    return out
