import json

import pytest

from searchpulse.__main__ import main


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    return str(tmp_path_factory.mktemp("jobs"))


def test_jobs_end_to_end(root, capsys):
    assert main(["generate", "--out", f"{root}/sent", "--hours", "3", "--per-hour", "500", "--end", "2024-01-30 22:00:00"]) == 0
    land = ["land", "--messages", f"{root}/sent", "--table", f"{root}/raw", "--checkpoint", f"{root}/cp", "--by-event-time", "--once"]
    assert main(land) == 0
    daily = ["daily", "--log", f"{root}/raw", "--root", f"{root}/out", "--as-of", "2024-01-30", "--run-ts", "2024-01-31 02:00:00"]
    assert main(daily) == 0
    stored = int(capsys.readouterr().out.split("stored ")[1].split()[0])
    assert 0 < stored <= 50

    seen, token = 0, []
    while True:
        main(["page", "--root", f"{root}/out", "--date", "2024-01-30", "--limit", "9", *token])
        page = json.loads(capsys.readouterr().out)
        assert page["date"] == "2024-01-30"
        seen += len(page["trending_queries"])
        if "next_token" not in page:
            break
        token = ["--token", page["next_token"]]
    assert seen == stored

    main(["page", "--root", f"{root}/out", "--date", "2020-01-01"])
    assert json.loads(capsys.readouterr().out) == {"date": "2020-01-01", "trending_queries": []}
    assert main(["check", "--log", f"{root}/raw", "--root", f"{root}/out", "--as-of", "2024-01-30"]) == 0
    assert main(["check", "--log", f"{root}/raw", "--root", f"{root}/out", "--as-of", "2024-03-31"]) == 1
    compress = ["compress", "--root", f"{root}/sent", "--out", f"{root}/gz", "--report", f"{root}/report"]
    assert main(compress) == 0
    assert "files_processed" in capsys.readouterr().out
