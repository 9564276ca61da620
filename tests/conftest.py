import pytest

from tessella.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(
        "local[8]", 4,
        **{
            "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()
