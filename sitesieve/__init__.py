"""sitesieve: web-crawl analytics on PySpark (see README.md).

The package's Python-side task code (the C2 HTML parser and the large
rule-set path of C6) is shipped inside each task: the package is registered
with PySpark's cloudpickle to be pickled by value, so executors need no
installed copy of it (the same effect as ``--py-files``).
"""

import sys as _sys

try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: ship the package with --py-files instead
    pass
