"""kinespark: sensor-trial analytics and grouped model evaluation as Spark DataFrame operators."""
