from . import registry

registry.load("scalar_plans", "window_plans", "aggregate_plans", "join_plans", "response_plans", "registration_plans", "kernel_plans", "stream_plans", "mask_plans", "feature_plans", "serving_plans", "storage_plans", "field_plans")
