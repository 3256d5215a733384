import pytest

from tidelog.__main__ import main
from tidelog.plans.queries import QUERIES


def test_commands(spark, sf, tmp_path, capsys):
    assert main(["list"]) == 0 and capsys.readouterr().out.split() == sorted(QUERIES)
    assert main(["sql", "log_end_offsets"]) == 0 and "vlog" in capsys.readouterr().out
    assert main(["run", "log_end_offsets", sf, "--out", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    assert main(["run", "log_end_offsets", sf, "--rows", "2"]) == 0 and "latest" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", sf])
