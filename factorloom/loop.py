"""The research loop: propose factors, evaluate them, keep the best, until enough iterations or a good enough factor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Iterations that the history keeps.
HISTORY = 20


@dataclass
class State:
    """What one iteration hands to the next."""

    iteration: int = 0
    feedback: dict = field(default_factory=dict)
    history: list[dict] = field(default_factory=list)
    best: list[dict] = field(default_factory=list)


def step(state: State, ranked: list[dict]) -> State:
    """The state after an iteration whose alphas, best first, are ``ranked`` (dicts with alpha_id and metrics)."""
    top = ranked[0] if ranked else {}
    feedback = {"iteration": state.iteration, "best_alpha_id": next((top[k] for k in ("alpha_id", "alphaID", "id") if top.get(k)), None), "metrics": top.get("metrics", {})}
    return State(state.iteration + 1, feedback, [*state.history, feedback][-HISTORY:], ranked)


def finished(state: State, max_iterations: int, target: float = 0.0) -> bool:
    """After enough iterations, or once the best information ratio reaches a positive target."""
    best = max((a.get("metrics", {}).get("information_ratio") or float("-inf") for a in state.best), default=float("-inf"))
    return state.iteration >= max(max_iterations, 1) or target > 0 and best >= target


def research(propose: Callable[[State], list[dict]], evaluate: Callable[[list[dict]], list[dict]], max_iterations: int = 1, target: float = 0.0) -> State:
    """``propose`` gives factors (alpha_id, dsl) from the state so far, ``evaluate`` ranks them."""
    state = State()
    while not finished(state, max_iterations, target):
        state = step(state, evaluate(propose(state)))
    return state
