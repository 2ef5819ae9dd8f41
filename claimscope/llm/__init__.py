"""Training-data operators: ten operators over ``documents``, ``embeddings``
and ``pages``, each a module with its own general interface.  ``queries``
registers one whole-table query per operator; nothing outside this
subpackage imports it."""
