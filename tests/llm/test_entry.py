"""Every numbered operator and the pipeline are registered."""
import __spark_entry__ as entry
import corpus_pipeline


def test_registered():
    names = entry.queries()
    for n in range(1, 14):
        assert len([k for k in names if k.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and [k for k, _ in corpus_pipeline.STAGES][0] == "language_id"
