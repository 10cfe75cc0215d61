import pytest

from meshline.plans import layers


def test_plans():
    assert layers.plan(["fare"]) == ["fare"]
    assert layers.plan(["fare"], "deps") == ["physical", "fare"]
    order = layers.plan(["physical"], "cascade")
    assert order[0] == "physical" and set(order) == set(layers.NEEDS)
    order = layers.plan(["interruption"], "deps")
    assert order.index("physical") < order.index("fare") < order.index("interruption")
    with pytest.raises(ValueError):
        layers.plan(["nothing"])
    with pytest.raises(ValueError, match="need each other"):
        layers.plan(["a", "b"], "isolated", {"a": ("b",), "b": ("a",)})


def test_run_stops_at_failure():
    done = []

    def bad():
        raise RuntimeError("no")

    out = layers.run(["a", "b", "c"], {"a": lambda: done.append("a"), "b": bad, "c": lambda: done.append("c")})
    assert done == ["a"] and [(o.layer, o.ok) for o in out] == [("a", True), ("b", False)]
    assert [o.message for o in layers.run(["a"], {}, dry=True)] == ["planned"]
