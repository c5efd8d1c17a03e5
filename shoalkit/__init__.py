"""Survey analytics as Spark DataFrame jobs.

``operators`` hold the building blocks, ``plans`` the batch refresh and the
parameterised views, ``sources`` the readers and writers, ``functions`` the column
helpers.
"""
