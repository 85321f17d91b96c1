from barograph.llm.queries import QUERIES


def test_every_operator_has_a_query():
    """Their twins run with all others in ``test_oracles``."""
    numbers = {n.split("_")[0] for n in QUERIES if n.startswith("op")}
    assert numbers == {f"op{k}" for k in range(1, 14)} and "pipeline" in QUERIES
