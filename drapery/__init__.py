"""drapery: product-catalog analytics as Spark DataFrame operators.

Every public operator is either a ``Column -> Column`` function (narrow,
stays inside whole-stage codegen) or a ``DataFrame -> DataFrame`` transform.
Nothing here collects data to the driver.
"""

__version__ = "0.1.0"
