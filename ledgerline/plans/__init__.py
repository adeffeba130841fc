"""Query plans: each registered query is a function ``(spark, sf_dir) ->
DataFrame`` that maps the driver's tables onto an operator's inputs
(the stand-ins of SURVEY §7.3) and calls the operator."""
