import pytest

from colscope.functions.labels import CATALOG_SCHEMA
from colscope.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_catalog(spark):
    """Catalog rows from {file: {column: type}}."""

    def make(files):
        rows = [
            (path.rsplit("/", 1)[-1], path, column, label, 0, 1, 10, 1.5, None)
            for path, columns in files.items()
            for column, label in columns.items()
        ]
        return spark.createDataFrame(rows, CATALOG_SCHEMA)

    return make


def flat(catalog_files):
    return [(f, c) for f in sorted(catalog_files) for c in sorted(catalog_files[f])]


@pytest.fixture(scope="session")
def tenants():
    """Columns of three tenants, with the naming noise such files have."""
    s, i, f = "string", "integer", "float"
    return {
        "customersAsia.csv": {"cust_id": i, "firstName": s, "email": s, "phone": s, "reg_date": s, "created_on": s, "zip": s},
        "eu_customers.csv": {"customerId": i, "firstName": s, "emailAddress": s, "phoneNumber": s, "created": s, "postalCode": i},
        "eu_orders.csv": {"orderId": i, "customerId": i, "orderDate": s, "unitPrice": f, "created": s, "notes": s},
        "ordersAsia.csv": {"orderID": i, "cust_id": i, "orderDt": s, "unit_price": f, "created_on": s, "zip": i},
        "simple_customers.csv": {"customer_id": i, "first_name": s, "email": s, "signup_date": s, "is_active": "boolean"},
        "simple_orders.csv": {"order_id": i, "customer_id": s, "price": f, "quantity": i, "order_date": s, "id": i, "ip": s},
    }
