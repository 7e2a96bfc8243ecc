"""Source-level guards for rules the engine keeps everywhere."""
import pathlib

PKG = pathlib.Path(__file__).resolve().parent.parent / "featurescape"


def _sources():
    return {p: p.read_text() for p in PKG.rglob("*.py")}


def test_no_local_checkpoint_or_cross_join():
    for p, src in _sources().items():
        assert "localCheckpoint" not in src, p
        assert "crossJoin" not in src, p
        assert ".checkpoint(" not in src, p       # lineage is cut by materialize()


def test_temp_folders_only_in_the_local_fallback():
    for p, src in _sources().items():
        if "tempfile" in src:
            assert p.name == "session.py", p
            assert 'sc.master.startswith("local")' in src
