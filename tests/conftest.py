import pytest

from seqloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="4g")
    # small tables: compiling every plan would take most of the time
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    return session
